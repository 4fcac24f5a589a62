"""Toxicity by a subsequence string-kernel machine with Nyström landmarks, trained on labelled sentences.

Labels say which documents are toxic, not which words make them so. The kernel of two words counts their common
subsequences of three letters, gaps and inserted characters paid for by a decay. A fixed number of words serve as
landmarks; the kernel to them, turned by the inverse root of the kernel among them, is a vector, and a linear support
vector machine judges it. A sentence scores as its highest word does, and is trained as such: in sentences of toxic
documents the word that scores highest is the witness that must be on the right side, in sentences of clean documents all
words must be on the other; all sentences of a document weigh 1 together. Witnesses are chosen anew after each fit. The
first witnesses are words that stand in toxic documents almost only and in many surroundings; what is seen of them also
comes with characters put in or left out. A logistic curve fitted to the labelled documents makes a probability of the
margins of a document's three highest words and of its length: what one insult says alone, three doubtful words say together.

The executors reduce the labelled sample to counts of words, then to a bounded number of short sentences, then to one
number a document: the driver never holds a text. As a subsequence of three letters is an explicit feature, landmarks and
weights collapse into one table over triples of letters, and every word of the corpus is judged by the whole machine.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import discard, forget, materialize, remembered

#: Labelled documents that the model is fitted on at most, toxic and clean ones alike by half.
SAMPLE = 4000
#: Of their words, the most frequent ones of either label that the driver sees; sentences of either label, and words of a sentence, a longer one being cut.
VOCABULARY, SENTENCES, SENTENCE_WORDS = 20_000, 3000, 40
#: Words of clean sentences that a fit adds, the hardest first.
HARDEST = 2500
#: Length of common subsequences and the decay for each letter that they span.
LENGTH, DECAY = 3, 0.7
#: Longest stretch of letters that is looked at as one word; longer words are read in stretches that overlap by LAP letters.
STRETCH, LAP = 16, 10
#: Words remembered by a worker before it starts anew; bounds memory, not results.
REMEMBERED = 250_000
#: Characters of text looked at together, a longer text alone, and rows read together.
CHUNK_CHARS, ROWS = 500_000, 500
LANDMARKS, SEEDS, ROUNDS, THRESHOLD = 240, 400, 3, 0.3
#: Margins below this are taken for this; a document is judged by its so many highest ones, repeats counted.
FLOOR, HIGHEST = -0.4, 3

_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s._*-]+){3,}[^\W\d_](?!\S)")
_ENDS = re.compile(r"[.!?|\n]+")
#: Digits and signs that stand for letters within a word.
_LEET = str.maketrans("013457@$", "oieastas")
_RUN = re.compile(r"(.)\1{2,}")
_LEET_IN = re.compile(r"(?=.*[^\W\d_])(?=.*[013457@$])")


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel, words by landmarks."""
    return _subsequences(words, landmarks) / own_size(words)[:, None] / own_size(landmarks)[None]


def own_size(words: list[str]) -> np.ndarray:
    """Root of each word's kernel with itself."""
    s = _codes(words)
    return np.sqrt(_common(s, s).clip(1e-12))


def _subsequences(words: list[str], landmarks: list[str]) -> np.ndarray:
    return _common(_codes(words)[:, None], _codes(landmarks)[None])


def _codes(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), max(map(len, words), default=1) or 1), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = list(map(ord, w))
    return out


def _common(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum over common subsequences of LENGTH letters of DECAY to the letters that they span in both; 0 pads words at their end."""
    shape, n, m = np.broadcast_shapes(s.shape[:-1], t.shape[:-1]), s.shape[-1], t.shape[-1]
    gaps = np.triu(DECAY ** np.subtract(*np.meshgrid(np.arange(m), np.arange(m))).clip(0))
    before = [np.ones((*shape, m + 1)), *(np.zeros((*shape, m + 1)) for _ in range(LENGTH - 1))]
    total = np.zeros(shape)
    for i in range(n):
        same = (s[..., i : i + 1] == t) & (s[..., i : i + 1] != 0)
        if not same.any():
            for b in before[1:]:
                b *= DECAY
            continue
        met = [DECAY * DECAY * same * b[..., :-1] for b in before]
        total += met[-1].sum(-1)
        for k in range(1, LENGTH):
            before[k] *= DECAY
            before[k][..., 1:] += met[k - 1] @ gaps
    return total


_PLACES: dict[int, tuple] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All i < j < k below n and the decay of each."""
    if n not in _PLACES:
        i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
        up = (i < j) & (j < k)
        _PLACES[n] = (i[up], j[up], k[up], DECAY ** (k[up] - i[up] + 1.0))
    return _PLACES[n]


class Features:
    """The kernel to some words as an explicit sum over the triples of letters that they hold."""

    def __init__(self, words: list[str]) -> None:
        self.alphabet = {ord(c): i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
        self.size = len(self.alphabet) + 1
        codes, weights = zip(*[self._codes_of(w) for w in words], strict=True)
        self.known, at = np.unique(np.concatenate(codes), return_inverse=True)
        self.table = np.zeros((len(self.known) + 1, len(words)), np.float32)  # the last row is that of all other triples
        column = np.repeat(np.arange(len(words)), [len(c) for c in codes])
        np.add.at(self.table, (at, column), np.concatenate(weights))
        self.own = own_size(words)

    def _codes_of(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        i, j, k, decay = _triples(len(word))
        c = np.array([self.alphabet.get(ord(x), 0) for x in word])
        return (c[i] * self.size + c[j]) * self.size + c[k], decay

    def kernel(self, words: list[str]) -> np.ndarray:
        """The normalised kernel, words by the words of the table."""
        out = np.zeros((len(words), self.table.shape[1]))
        for row, word in enumerate(words):
            code, decay = self._codes_of(word)
            at = np.searchsorted(self.known, code).clip(0, len(self.known) - 1)
            at = np.where(self.known[at] == code, at, len(self.known))
            out[row] = decay @ self.table[at]
        return out / own_size(words)[:, None] / self.own[None] if words else out


def letters(token: str) -> str:
    return "".join(filter(str.isalpha, token))


def readings(token: str) -> list[str]:
    """The letters of a lower-cased token, also with digits and signs read as letters and with runs of a letter as one, each as its marked stretches of LENGTH letters at least."""
    forms = {letters(token)}
    if _LEET_IN.match(token):
        forms.add(letters(token.translate(_LEET)))
    forms.update([_RUN.sub(r"\1", form) for form in forms])
    return [s for form in forms if len(form) >= LENGTH for s in stretches(form)]


def stretches(word: str) -> list[str]:
    """The word between marks of its start and end, in overlapping stretches if it is long."""
    word = f"^{word}$"
    if len(word) <= STRETCH:
        return [word]
    return [word[i : i + STRETCH] for i in range(0, len(word) - LAP, STRETCH - LAP)]


def marked(words: list[str]) -> list[str]:
    return [f"^{w}$" for w in words]


def tokens_of(text: str) -> list[str]:
    """What a text is judged by: its lower-cased words, and words spelled out letter by letter."""
    lowered = text.lower()
    return lowered.split() + [letters(m[0]) for m in _SPELLED.finditer(lowered)]


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence, SENTENCE_WORDS at most; longer ones are cut."""
    for part in _ENDS.split(text.lower()):
        words = part.split()
        for i in range(0, len(words), SENTENCE_WORDS):
            yield words[i : i + SENTENCE_WORDS]


@dataclass
class Model:
    """What is broadcast: the machine as a table over triples of letters, and the curve from margins to probabilities."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = -1.0
    #: Weights of the highest margins and of the logarithm of the number of words, then the constant.
    curve: np.ndarray = field(default_factory=lambda: np.zeros(HIGHEST + 2))
    #: Words met so far: those above the floor with their margin, the rest by name alone.
    near: dict[str, float] = field(default_factory=dict)
    plain: set[str] = field(default_factory=set)
    alphabet: dict[int, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def collapse(self) -> Model:
        """Sum of the landmarks' weighted features: weight of each triple of letters."""
        known = sorted({ord(c) for w in self.landmarks for c in w})
        self.alphabet = {c: i for i, c in enumerate(known, 1)}
        size = len(known) + 1
        self.table = np.zeros(size**3)
        for w, scale in zip(self.landmarks, self.weights / own_size(self.landmarks), strict=True):
            i, j, k, decay = _triples(len(w))
            c = np.array([self.alphabet[ord(x)] for x in w])
            np.add.at(self.table, (c[i] * size + c[j]) * size + c[k], decay * scale)
        return self

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of marked words or stretches; words too short for a subsequence have the bias."""
        out = np.full(len(words), self.bias)
        size, length = len(self.alphabet) + 1, np.array([len(w) for w in words])
        for n in np.unique(length[length >= LENGTH]).tolist():
            at = np.flatnonzero(length == n)
            i, j, k, decay = _triples(n)
            for lo in range(0, len(at), max(1, CHUNK_CHARS // 4 // len(i))):
                some = at[lo : lo + max(1, CHUNK_CHARS // 4 // len(i))]
                raw = np.frombuffer("".join(words[x] for x in some).encode("utf-32-le"), np.int32).reshape(-1, n)
                seen, back = np.unique(raw, return_inverse=True)
                c = np.array([self.alphabet.get(x, 0) for x in seen.tolist()])[back].reshape(-1, n)
                own = np.sqrt(_common(raw, raw).clip(1e-12))
                out[some] += (self.table[(c[:, i] * size + c[:, j]) * size + c[:, k]] @ decay) / own
        return out

    def learn_words(self, new: set[str]) -> None:
        parts = {token: readings(token) for token in new}
        todo = sorted({p for found in parts.values() for p in found})
        value = dict(zip(todo, self.margins(todo).tolist(), strict=True))
        for token, found in parts.items():
            most = max((value[p] for p in found), default=FLOOR)
            if most > FLOOR:
                self.near[token] = most
            else:
                self.plain.add(token)

    def documents(self, texts: list[str]) -> np.ndarray:
        """For each document the margins of its highest words, not below the floor, and the logarithm of its length."""
        out = np.full((len(texts), HIGHEST + 1), FLOOR)
        start = 0
        while start < len(texts):
            met, at, size = [], start, 0
            while start < len(texts) and (not met or size + len(texts[start]) <= CHUNK_CHARS):
                met.append(tokens_of(texts[start]))
                size += len(texts[start])
                start += 1
            new = set().union(*met) if self.table is not None else set()
            if len(self.plain) + len(self.near) + len(new) > REMEMBERED:
                self.plain.clear()
                self.near.clear()
            self.learn_words((new - self.plain) - self.near.keys())
            for row, tokens in enumerate(met, at):
                hits = self.near.keys() & set(tokens)
                if hits:
                    found = sorted((self.near[t] for t in tokens if t in hits), reverse=True)[:HIGHEST]
                    out[row, : len(found)] = found
                out[row, -1] = np.log1p(len(tokens))
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.documents(texts) @ self.curve[:-1] + self.curve[-1])


def flat(toxic: int, clean: int) -> Model:
    """Where nothing can be learned: all texts score the rate of labels."""
    rate = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.05
    return Model(curve=np.r_[np.zeros(HIGHEST + 1), np.log(rate / (1 - rate))])


def seeds_of(words: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """The first witnesses, of rows (word, toxic documents, surroundings there, clean documents): ten times as frequent in
    toxic documents as in clean ones, in at least 1.5 % of the toxic ones, and in as many surroundings (a copied passage always stands between the same words)."""
    least = max(4, 0.015 * n_toxic)
    good = [(t, w) for w, t, around, c in words if t >= least and around >= max(least, 0.7 * t) and (c + 0.5) / (n_clean + 1) < 0.1 * t / (n_toxic + 1)]
    return [w for _, w in sorted(good, key=lambda x: (-x[0], x[1]))[:SEEDS]]


def learn(words: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int, toxic: list[tuple[float, list[str]]], clean: list[tuple[float, list[str]]], landmarks: int = LANDMARKS) -> Model | None:
    """A machine from counted words and labelled sentences (weight, words' letters); None where there are no witnesses."""
    seeds = seeds_of(words, n_toxic, n_clean)
    if not seeds:
        return None
    r = np.random.default_rng(0)
    varied = {w: _varied(w, r) for w in seeds if len(w) > 3}
    ordinary = [w for w, t, _, c in sorted(words, key=lambda x: (-x[3], x[0])) if c and c * n_toxic >= t * n_clean and len(w) >= LENGTH and stretches(w) == marked([w])]
    kept = set(ordinary) - set(seeds)
    ordinary = [w for w in ordinary if w in kept]
    # Landmarks: witnesses, ordinary words that are most like them, and the most common ones.
    first = seeds[: landmarks // 2]
    alike = Features(marked(first)).kernel(marked(ordinary[:4000])).max(1) if ordinary else np.zeros(0)
    hard = [ordinary[x] for x in np.argsort(-alike, kind="stable")[:2000]]
    chosen = dict.fromkeys([*first, *hard[: landmarks // 4], *ordinary])
    model = Model(landmarks=marked(list(chosen)[:landmarks]))
    values, vectors = np.linalg.eigh(kernel(model.landmarks, model.landmarks))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    explicit, features = Features(model.landmarks), {}

    def of(some: list[str]) -> np.ndarray:
        new = [w for w in some if w not in features]
        for lo in range(0, len(new), 256):
            features.update(zip(new[lo : lo + 256], explicit.kernel(marked(new[lo : lo + 256])) @ root, strict=True))
        return np.array([features[w] for w in some])

    fits = lambda w: len(w) >= LENGTH and len(w) + 2 <= STRETCH
    bags = [(c, b) for c, s in toxic for b in [[w for w in dict.fromkeys(s) if fits(w) and w not in kept]] if b]

    def chosen_by(rank) -> Counter:
        out = Counter()
        for c, b in bags:
            out[max(b, key=rank)] += c
        return out

    against = Counter()
    for c, s in clean:
        for w in dict.fromkeys(s):
            if fits(w):
                against[w] += c
    against.update([*ordinary[:500], *hard[:1000]])
    pool = sorted(against)
    place = {w: -n for n, w in enumerate(seeds)}
    witnesses = chosen_by(lambda w: (place.get(w, -SEEDS), w))
    negative: dict[str, None] = {}
    for _ in range(ROUNDS):
        if model.table is not None:
            every = sorted({w for _, b in bags for w in b})
            value = dict(zip(every, model.margins(marked(every)).tolist(), strict=True))
            witnesses = chosen_by(lambda w: (value[w], w))  # noqa: B023
            # All words of clean sentences count; the machine is fitted on those that it is most wrong about.
            order = np.argsort(-model.margins(marked(pool)), kind="stable")[:HARDEST]
            negative |= dict.fromkeys(pool[x] for x in order)
        else:
            negative = dict.fromkeys([w for w, _ in against.most_common(HARDEST)])
        weight = {w: witnesses[w] or 0.1 for w in [*seeds, *witnesses]}
        for w, forms in varied.items():
            for v in forms:
                weight[v] = max(weight.get(v, 0.0), 0.5 * weight[w] / len(forms))
        x = np.concatenate([of(list(weight)), of(list(negative))])
        y = np.r_[np.ones(len(weight)), -np.ones(len(negative))]
        w, b = _svm(x, y, np.r_[list(weight.values()), [against[w] for w in negative]])
        model.weights, model.bias = root @ w, min(b, -0.1)
        model.collapse()
    return model


def _varied(word: str, r: np.random.Generator) -> list[str]:
    """The word with one or two characters put in, doubled, or one left out."""
    out = []
    for _ in range(4):
        w = list(word)
        for _ in range(r.integers(1, 3)):
            at = int(r.integers(1, len(w)))
            w.insert(at, w[at - 1] if r.random() < 0.4 else chr(97 + int(r.integers(26))))
        out.append("".join(w))
    at = int(r.integers(1, len(word) - 1))
    return [*out, word[:at] + word[at + 1 :]]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by accelerated gradient steps."""
    share = weight / weight.sum()
    z = np.c_[x, np.ones(len(x))]
    step = 1 / (2 * np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2 + strength)
    v = u = np.zeros(z.shape[1])
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (z @ u))
        gradient = -2 * z.T @ (share * y * short) + strength * np.r_[u[:-1], 0]
        new = u - step * gradient
        u, v = new + k / (k + 3) * (new - v), new
    return v[:-1], float(v[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, draw: float = 0.1) -> np.ndarray:
    """Weights of the columns and a constant by Newton steps, slightly drawn to zero; no margin counts against a document."""
    use = list(range(x.shape[1]))
    while True:
        z = np.c_[x[:, use], np.ones(len(x))]
        a = np.zeros(z.shape[1])
        penalty = np.r_[np.full(len(use), draw), 1e-6]
        for _ in range(100):
            p = _sigmoid(z @ a)
            move = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * a)
            a = a - np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        bad = [c for c, v in zip(use, a, strict=False) if c < HIGHEST and v < 0]
        if not bad:
            break
        use = [c for c in use if c not in bad]
    out = np.zeros(x.shape[1] + 1)
    out[use], out[-1] = a[:-1], a[-1]
    return out


def held_out(key) -> F.Column:
    """Rows that no label is learned from: crc32 of the key as text, modulo 4, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (word, label, around): each word of a document once, with the words about its first place."""
    forget()
    for batch in batches:
        words, labels, around = [], [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row, seen = ["", *map(letters, text.lower().split()), ""], set()
            for i, w in enumerate(row[1:-1], 1):
                if len(w) >= LENGTH and len(w) + 2 <= STRETCH and w not in seen:
                    seen.add(w)
                    words.append(w)
                    labels.append(label)
                    around.append(f"{row[i - 1]} {row[i + 1]}")
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(around, pa.string())], names=["word", "label", "around"])


def _sentences(seeds: list[str], model: Model | None):
    """(text, label) -> (label, sentence, weight): of toxic texts those that hold a seed; of clean ones all, or those that the model takes for toxic. All that a document gives weigh 1 together."""
    wanted = set(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, out, weights = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [row for words in sentences(text) for row in [[w for w in map(letters, words) if w]] if row]
                if label:
                    rows = [row for row in rows if not wanted.isdisjoint(row)]
                elif model is not None:
                    every = sorted({w for row in rows for w in row if LENGTH <= len(w) <= STRETCH - 2})
                    high = {w for w, m in zip(every, model.margins(marked(every)).tolist(), strict=True) if m > FLOOR / 2}
                    rows = [row for row in rows if not high.isdisjoint(row)]
                labels += [label] * len(rows)
                out += [" ".join(row) for row in rows]
                weights += [1.0 / max(1, len(rows))] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.string()), pa.array(weights, pa.float64())], names=["label", "sentence", "weight"])

    return run


def _some(said: DataFrame, label: int, share: float) -> list[tuple[float, list[str]]]:
    """SENTENCES of a label at most, taken in the order of a hash; their weights are scaled to those of all, times `share`."""
    mine = said.where(F.col("label") == label)
    kept = mine.orderBy(F.xxhash64("sentence"), "sentence", "weight").limit(SENTENCES).collect()
    whole = mine.agg(F.sum("weight")).first()[0] if len(kept) == SENTENCES else None
    scale = share * whole / sum(r.weight for r in kept) if whole else share
    return [(scale * r.weight, r.sentence.split()) for r in kept]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents that are not held out, half of them toxic as far as there are so many, taken in the order of a hash of their key.

    Null texts are empty; null keys and labels teach nothing; a key labelled both ways is toxic. Without toxic or without
    clean documents, or without words that tell them apart, all texts score the rate of labels.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = None
    for value in (1, 0):
        ids = marks.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
        picked = ids if picked is None else picked.unionByName(ids)
    # The sample is bounded by its parameter, so its keys may be broadcast; texts stay on the executors.
    picked = materialize(picked, "toxic-keys")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "label"), "toxic-sample")
    # What a document of the sample stands for: the labels keep their rate.
    every = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {v: max(every[v], n[v]) / n[v] for v in n}
    model = None
    if n.get(1) and n.get(0):
        met = rows.mapInArrow(_counted, "word string, label int, around string")
        places = met.groupBy("word", "label", "around").count().groupBy("word", "label").agg(F.sum("count").alias("docs"), F.count("*").alias("around"))
        both = places.groupBy("word").agg(*[F.coalesce(F.max(F.when(F.col("label") == v, F.col(c))), F.lit(0)).alias(a) for v, c, a in ((1, "docs", "toxic"), (1, "around", "around"), (0, "docs", "clean"))])
        top = [both.orderBy(F.desc(c), "word").limit(VOCABULARY) for c in ("toxic", "clean")]
        words = [(r.word, r.toxic, r.around, r.clean) for r in top[0].union(top[1]).distinct().orderBy("word").toLocalIterator()]
        seeds = seeds_of(words, n[1], n[0])
        if seeds:
            # A first fit tells which sentences of clean documents are hard; they teach the second one.
            said = materialize(rows.mapInArrow(_sentences(seeds, None), "label int, sentence string, weight double"), "toxic-said")
            toxic, clean = _some(said, 1, share[1]), _some(said, 0, share[0])
            model = learn(words, n[1], n[0], toxic, clean)
            if model is not None:
                hard = materialize(rows.where("label = 0").mapInArrow(_sentences(seeds, model), "label int, sentence string, weight double"), "toxic-hard")
                model = learn(words, n[1], n[0], toxic, clean[: SENTENCES // 3] + _some(hard, 0, share[0]))
                discard(hard)
            discard(said)
    if model is None:
        model = flat(n.get(1, 0), n.get(0, 0))
    else:
        kept = rows.mapInArrow(_judged(model), "features array<double>, label int").toArrow()
        label_of = kept.column(1).to_numpy().astype(float)
        model.curve = _logistic(np.array(kept.column(0).to_pylist()), label_of, np.where(label_of > 0, share[1], share[0]))
    for x in (picked, rows):
        discard(x)
    return model


def _judged(model: Model):
    """(text, label) -> (features, label) of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.documents(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(made.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["features", "label"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and `out`: the probability that a text is toxic, by its words alone. Null texts are empty. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, name = [c for c in docs.columns if c != out], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = remembered(name, lambda: shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # few texts at a time as strings of Python
                batch = whole.slice(at, ROWS)
                made = mine.probabilities([t or "" for t in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.float64())], names=[*keep, out])

    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, docs.select(*keep).schema.add(out, "double"))
