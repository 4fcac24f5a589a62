import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import common, ngram_join, queries

SPACE = " \t\n\v\f\r"


def brute_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for c in SPACE[1:]:
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = brute_sets([t for _, t in rows])
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]) and None not in (rows[i][0], rows[j][0]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé\x1cx", max_size=40), max_size=6))
def test_sets_are_those_of_words(texts):
    made = list(common.shingle_sets(pa.array(texts, pa.string())))
    want = brute_sets(texts)
    assert [len(s) for s in made] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(made[i], made[j])) == len(want[i] & want[j])


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda k=400: f"w{r.randrange(k)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.35 and rows:
            base = r.choice(rows)[1].split(" ")
            for _ in range(r.randrange(3)):
                base[r.randrange(len(base))] = word()
            text = " ".join(base)
        elif kind < 0.55:
            text = " ".join([*passage, *[word() for _ in range(r.randrange(14))]])
        elif kind < 0.65:
            text = " ".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
        else:
            text = " ".join(word() for _ in range(r.randrange(5, 120)))
        rows.append((i, text))
    base = [word() for _ in range(80)]
    for i in range(n, n + 60):  # a large group of near copies
        copy = list(base)
        copy[r.randrange(80)] = word()
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE_UP_TO", 4)
    rows = corpus(seed)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def fillers(passage, but=()):
    """Short documents that make each shingle of the passage frequent."""
    return [[*passage[i : i + 5], f"f{i}.{k}"] for i in range(len(passage) - 4) if i not in but for k in range(ngram_join.RARE_UP_TO + 1)]


def boilerplate(seed):
    """Short documents of a common passage, in pairs whose ends differ by about as many words as the threshold allows."""
    r = random.Random(seed)
    own = lambda k: [f"o{r.randrange(10**9)}" for _ in range(k)]
    rows = []
    for n in (14, 18, 34):
        passage = own(n)
        rows += fillers(passage)
        for _ in range(30):
            tail = own(r.randrange(2, 2 + n // 2))
            other = own(r.randrange(1, 2 + n // 6))
            rows += [passage + tail, passage + tail[: max(0, len(tail) - r.randrange(len(other) + 1))] + other]
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_borderline_pairs_of_short_boilerplate(spark):
    rows = boilerplate(1)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_frequent_token_beside_one_of_many_sets(spark):
    passage = [f"p{i}" for i in range(19)]  # 15 shingles; with five words more 20, of which 15 are common
    name = lambda i: int(next(iter(common.shingle_sets(pa.array([" ".join(passage[i : i + 5])]))))[0])
    words = [passage, *[passage + [f"x{k}.{i}" for i in range(5)] for k in range(30)], *fillers(passage, [max(range(15), key=name)])]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_nulls_copies_long_texts_and_clashes(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, "a b c d e f"), (3, "A  b c\td e f"), (9, None), (8, ""), (7, " \n"), (6, "one two"), (2, "one two"), (4, "two one"), (None, "a b c d e f"), (5, "a b c d e f"), (11, long), (10, long + " tail")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, kind int")
    assert sorted(map(tuple, ngram_join.jaccard_classes(docs).collect()), key=str) == brute(rows)
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_ngram_join(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_representatives(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], "y"), (rows[5][0], rows[5][1], "z")], "doc_id long, text string, __met string").withColumnRenamed("__met", "component_id")
    want = {d for d, _, c in brute(rows) if d == c}
    for slots in (1 << 16, 64):  # with few bits most rows meet the dropped keys
        monkeypatch.setattr(ngram_join, "_slots", lambda n, slots=slots: slots)
        got = ngram_join.representatives(docs)
        assert got.columns == docs.columns
        got = got.collect()
        assert {r.doc_id for r in got} == want | {None} and len(got) == len(want) + 1 + (rows[5][0] in want)
    assert ngram_join.representatives(docs.limit(0)).count() == 0
