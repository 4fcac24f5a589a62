"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the encoding has one last token, so a piece is stored as the list of the last tokens of its
prefixes: an append extends the list, an edit recomputes it from the edited byte on, and the encoding is read backwards
from the end. A token may follow another exactly when merging their joined bytes gives back the two.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import remembered, sliced

#: Pieces and token pairs that a worker remembers before it starts anew; this bounds memory, not results.
REMEMBERED = 600_000
#: Characters of text that are split into pieces at once, each piece an object; a longer text is split alone.
SPLIT_CHARS = 1_000_000
#: Stands between pieces that are encoded together; no byte of any token.
BORDER = "\u0100"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def narrow_pattern(pattern: str) -> str:
    """The pattern for texts of code points below 256 only, its classes spelled out as ranges: the standard engine then runs it from a bitmap."""
    narrow = "".join(map(chr, range(256)))

    def ranges(name: str) -> str:
        return "".join(f"\\x{ord(m[0][0]):02x}-\\x{ord(m[0][-1]):02x}" for m in regex.finditer(rf"(?:{name})+", narrow))

    pattern = pattern.replace(r"\S", r"[^\s]")
    pattern = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{\w+\}|\\s", lambda c: ranges(c[0]), m[0]), pattern)
    return re.sub(r"\\p\{\w+\}|\\s(?![0-9a-f-])", lambda c: f"[{ranges(c[0])}]", pattern)


class PrefixBPE:
    """Encoder and decoder over mergeable ranks; `pattern` splits a text into the pieces that are encoded apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = REMEMBERED):
        self.ranks = ranks
        self.most = most
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.size_of = {rank: len(token) for rank, token in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.split_wide = regex.compile(pattern).findall
        self.split_narrow = re.compile(narrow_pattern(pattern)).findall
        self.lengths: dict[bytes, tuple[int, ...]] = {}  # by their last three bytes, of the tokens that have so many
        for token in ranks:
            if len(token) > 2:
                self.lengths[token[-3:]] = (*self.lengths.get(token[-3:], ()), len(token))
        self.lengths = {end: tuple(sorted(set(found), reverse=True)) for end, found in self.lengths.items()}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None for a single byte: merging below its rank ends in these."""
        if token not in self.made_of:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                ranked = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1], token)) < token]
                if not ranked:
                    raise ValueError(f"token {token} is not reached by merges of lower rank")
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made_of[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether `right` after `left` is how their joined bytes are encoded.

        Undoes the later of the two merges at the border again and again; the border holds unless the two parts that
        meet there merge before either is taken into its own token, the left one first where ranks are equal.
        """
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= 4 * self.most:
                self.follows.clear()
            x, y, x_until, y_until, known = left, right, 1 << 60, 1 << 60, True
            while True:
                rank = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if rank is not None and rank < x_until and rank <= y_until:
                    known = False
                    break
                x_of, y_of = self.halves(x), self.halves(y)
                if x_of is None and y_of is None:
                    break
                if y_of is None or (x_of is not None and x > y):
                    x, x_until = x_of[1], x
                else:
                    y, y_until = y_of[0], y
            self.follows[left, right] = known
        return known

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """Last tokens of all prefixes of data, given those up to length `start`; last[0] is -1."""
        last = last[: start + 1]
        ranks, follows, lengths = self.ranks.get, self.follows.get, self.lengths.get
        for end in range(start + 1, len(data) + 1):
            for length in (*lengths(data[end - 3 : end] if end > 2 else b"", ()), 2, 1):
                begin = end - length
                if begin < 0:
                    continue
                token = ranks(data[begin:end])
                if token is not None:
                    left = last[begin]
                    if left < 0 or (valid := follows((left, token))) or (valid is None and self.may_follow(left, token)):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
        return last

    def prefixes(self, data: bytes) -> list[int]:
        return self.extend(data, [-1], 0)

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The piece with `more` at its end; only the new prefixes are computed."""
        return data + more, self.extend(data + more, last, len(data))

    def edit(self, data: bytes, last: list[int], begin: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes begin..end replaced; prefixes before the edit stay."""
        changed = data[:begin] + put + data[end:]
        return changed, self.extend(changed, last, begin)

    def read_back(self, last: list[int]) -> list[int]:
        """The tokens, from the last tokens of all prefixes."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_wide(text)
        return self.split_narrow(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before. An automaton over the vocabulary lists, prefix by prefix, the tokens that end there, longest first."""
        todo = []
        for piece in pieces:
            whole = self.ranks.get(piece.encode())
            if whole is None:
                todo.append(piece)
            else:
                self.pieces[piece] = (whole,)
        if not todo:
            return
        joined = BORDER.join([p.encode().decode("latin-1") for p in todo])
        last: list[int | None] = [None] * (len(joined) + 1)
        last[0] = -1
        for i, c in enumerate(joined):
            if c == BORDER:
                last[i + 1] = -1
        follows = self.follows.get
        for at, (token, length) in self.automaton.iter(joined):
            if last[at + 1] is None:
                left = last[at + 1 - length]
                if left < 0 or (valid := follows((left, token))) or (valid is None and self.may_follow(left, token)):
                    last[at + 1] = token
        end, size = len(joined), self.size_of
        for piece in reversed(todo):
            ids = []
            while (token := last[end]) >= 0:
                ids.append(token)
                end -= size[token]
            end -= 1
            self.pieces[piece] = tuple(ids[::-1])

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The tokens of each text. Texts are split a million characters at a time."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= SPLIT_CHARS):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[start:end]]
            met = set(chain.from_iterable(split))
            if len(self.pieces) + len(met) > self.most:
                self.pieces.clear()
            self.learn(met - self.pieces.keys())
            for pieces in split:
                yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
            start = end

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and `ids` array<int>: the tokens of the whole text, null as empty.

    The vocabulary is read on the driver and broadcast; its size is that of the file, whatever the input's.
    An existing column of the name `ids` is replaced. One pass, no shuffle.
    """
    return _with_encoder(docs, ranks_path, pattern, text, lambda bpe, texts: {ids: pa.array(list(bpe.encode_all(texts)), pa.list_(pa.int32()))}, {ids: "array<int>"}, [c for c in docs.columns if c != ids])


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns of encoded and `out` binary: the bytes that the ids stand for, null ids as empty."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    keep = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in ranks.value.items()}
        for batch in batches:
            made = [b"".join(map(bytes_of.__getitem__, x or [])) for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*keep, out])

    fields = encoded.select(*keep).schema
    return encoded.select(*keep).mapInArrow(run, fields.add(out, "binary"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", most: int = REMEMBERED) -> DataFrame:
    """One row a document: key, n_tokens, ids_sha256 of the ids in decimal and decoded_sha256 of the bytes decoded from them.

    Encodes and decodes in one pass, so that the ids of a corpus are never stored for their digest alone. A worker remembers
    `most` pieces, which bounds its memory, not the result.
    """

    def run(bpe: PrefixBPE, texts: list[str]) -> dict[str, pa.Array]:
        n, ids_hash, decoded_hash = [], [], []
        for ids in bpe.encode_all(texts):
            n.append(len(ids))
            ids_hash.append(sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
            decoded_hash.append(sha256(bpe.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash), "decoded_sha256": pa.array(decoded_hash)}

    return _with_encoder(docs, ranks_path, pattern, text, run, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, [key], most)


def _with_encoder(docs: DataFrame, ranks_path: str, pattern: str, text: str, make, fields: dict[str, str], keep: list[str], most: int = REMEMBERED) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names, name = [*keep, *fields], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One encoder for each worker process, so that what it remembers serves all its tasks.
        bpe = remembered(name, lambda: PrefixBPE(ranks.value, pattern, most))
        for batch in sliced(batches):
            made = make(bpe, ["" if t is None else t for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made.values()], names=names)

    schema = docs.select(*keep).schema
    for field, kind in fields.items():
        schema = schema.add(field, T.DataType.fromDDL(kind))
    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)
