import re

import numpy as np
import pytest

from panelspark.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(words, weights=(5, 2, 1), most=3):
    """The contract's rule step by step: share by weight, stop what is above, share the rest again."""
    order = sorted(s for s in words if s is not None) + ([None] if None in words else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(words.values())), order
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * words[s]]
        out |= {s: left * weight[s] / total for s in open_} if not over else {s: float(most * words[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out] if over else []
    return out


@pytest.mark.parametrize("words", [{"a": 100, "b": 100, "c": 100}, {"b": 10, "a": 10, None: 580}, {"a": 0}, {"a": 0, "b": 5}, {"é": 1, "Z": 2, "z": 3, "a": 400, "": 1, "b": 2, None: 7}, {f"s{i}": (i * 37) % 101 for i in range(200)}])
def test_targets_are_shared_capped_and_shared_again(spark, words):
    df = spark.createDataFrame(list(words.items()), "source string, words long")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(shared(words))
    assert mixing.targets(df.limit(0)).count() == 0


def test_flight_holds_totals():
    r = np.random.default_rng(1)
    size = r.integers(1, 1000, 500)
    p = np.full(500, 0.37)
    out = mixing.flight(p, size, r.random(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_inclusion_probabilities_are_kept_at_every_size(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as source", "array_join(array_repeat('w', cast(1 + pmod(xxhash64(id), 999) as int)), ' ') as text").repartition(4)
    extra = spark.createDataFrame([(-1, "y", "w " * 6_300_000)], "doc_id long, source string, text string")
    got = mixing.mix(docs.unionByName(extra)).where("source = 'x'").toPandas()
    p = got.target[0] / got.source_size[0] % 1
    assert 0.1 < p < 0.9
    kept = got.times - got.target[0] // got.source_size[0]
    for lo in range(0, 1000, 200):
        assert abs(kept[(got["size"] > lo) & (got["size"] <= lo + 200)].mean() - p) < 0.025


@pytest.mark.parametrize("block", [4_000, 50])
def test_query_meets_its_contract(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op2_cube_mixing(spark, sf).collect()}
    again = {r.doc_id: r for r in queries.op2_cube_mixing(spark, sf).collect()}
    assert got == again and len(got) == len(docs)
    words = {}
    for d in docs:
        assert got[d.doc_id].size == len(WORD.findall(d.text))
        words[d.source] = words.get(d.source, 0) + got[d.doc_id].size
    want = shared(words)
    for s in words:
        mine = [got[d.doc_id] for d in docs if d.source == s]
        taken = sum(r.taken for r in mine)
        assert all(r.source_size == words[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(taken - want[s]) <= max(50, 0.01 * want[s])
        assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mine)


def test_nulls_ties_and_empty(spark):
    named = spark.createDataFrame([("k1", "a b", "x"), ("k2", "c", "x"), (None, "c d e", "x")], "doc_id string, text string, source string")
    assert mixing.mix(named).count() == 3
    rows = [(1, "a b", "x", 0), (1, "a b", "x", 0), (None, "c", "x", 0), (2, None, None, 0), (3, "d e f", None, 0), (4, "", "y", 0), (5, "z " * 50_000, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert sorted((r.size for r in got)) == [0, 0, 1, 2, 2, 3, 50_000]
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_landing_is_near_for_every_draw():
    """A source with one document of most of its target: the words come near whether or not it is taken, and it is taken as often as it should be."""
    rng = np.random.default_rng(1)
    size = np.sort(np.append(rng.integers(20, 700, 48), [1834, 5184]))[::-1].astype(float)
    p, taken = 7094 / size.sum(), np.zeros(50)
    for seed in range(300):
        got = mixing._land(np.full(50, p), size, np.random.default_rng(seed).random(50))
        assert set(got) <= {0.0, 1.0} and abs((got * size).sum() - 7094) <= 71
        taken += got
    assert abs(taken[0] / 300 - p) < 0.09
