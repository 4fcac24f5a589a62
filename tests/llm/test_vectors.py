import numpy as np
import pytest

from panelspark.llm import ann, embed_dedup, queries

ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [None] + [1.0] * 7, 1), (904, [float("nan")] + [1.0] * 7, 1), (905, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]


def rows_of(seed, n=400, width=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, width))
    made = []
    for i in range(n):
        v = centres[r.integers(40)] + r.normal(size=width) * r.choice([0.02, 0.1, 1.0])
        made.append((i, (v * r.uniform(0.5, 2)).astype(np.float32).tolist(), int(r.integers(3)) if r.random() < 0.95 else None))
    made += [(n + i, made[0][1], made[0][2]) for i in range(30)]
    return made


def brute_dedup(rows, threshold):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v, _ in ok])
    label = np.array([g for *_, g in ok])
    link = (u @ u.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    ids = np.array([i for i, *_ in ok])
    comp = ids.copy()
    while True:
        new = np.array([min(comp[a], comp[link[a]].min(initial=comp[a])) for a in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    found = {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), comp, strict=True)}
    return {i: (*found.get(i, (0, i)), i == found.get(i, (0, i))[1]) for i, *_ in rows if i is not None}


@pytest.mark.parametrize("tile", [7, 1500])
def test_dedup_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = rows_of(tile) + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string").repartition(6)
    got = embed_dedup.near_vectors(df, threshold=0.98).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute_dedup(rows, 0.98)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(9)
    long, short = r.normal(size=(20, 8)), r.normal(size=4)
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(long)] + [(20 + i, (short + 0.01 * r.normal(size=4)).astype(np.float32).tolist(), 1) for i in range(4)]
    rows += [(30, [1.0], 1), (31, [2.0], 1), (32, [-1.0], 1), (33, [1.0, 0.0], 1), (34, [1.0, 0.05], 1)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), threshold=0.98)
    found = {x.vec_id: (x.n_links, x.component_id) for x in got.collect()}
    assert all(found[i] == (3, 20) for i in range(20, 24)) and found[30] == found[31] == (1, 30) and found[32] == (0, 32) and found[33] == found[34] == (1, 33)


def test_suffix_bounds_lose_nothing():
    r = np.random.default_rng(3)
    a, b = (embed_dedup.normalised(r.normal(size=(60, 40))) for _ in range(2))
    b[:20] = embed_dedup.normalised(a[:20] + 0.05 * r.normal(size=(20, 40)))
    i, j = embed_dedup.reaching(a, b, 0.9)
    assert set(zip(*np.nonzero(a @ b.T >= 0.9), strict=True)) == set(zip(i, j, strict=True))


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            out[q] = sorted(((-float(v @ w), i) for i, w in ok if i != q))[:k]
    return out


def test_search_on_odd_rows_ties_and_few(spark):
    rows = rows_of(5) + ODD
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, label int, score int").repartition(6)
    want = brute_nearest(rows, 20, 20)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, 21)) and q not in {v for v, _ in ranked.values()}
        order = [(-s, v) for _, (v, s) in sorted(ranked.items())]
        assert order == sorted(order)
    few = ann.nearest(df.where("vec_id < 5"), every=2)
    assert sorted((r.query_id, r["rank"]) for r in few.collect()) == [(q, k) for q in (0, 2, 4) for k in (1, 2, 3, 4)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_queries_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_dedup(rows, 0.98)
    want = brute_nearest(rows, 20, 20)
    found = {}
    for r in queries.op1_posting_lists(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found.keys() == want.keys()
    assert sum(len(found[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)
