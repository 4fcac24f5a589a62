"""Models, quantile lines, exact quantiles and overlays against dense numpy and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import models as M
from panelspark.operators import quantiles as Q
from panelspark.operators import spatial as G


def cases(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, x, z = rng.choice("pqrs"), rng.choice("uvw"), rng.uniform(0, 5), rng.gauss(0, 2)
        rows.append((i, 2 + 0.5 * x - z + "pqrs".index(a) + 3 * (b == "w") + rng.gauss(0, 1), x, z, a, b, rng.randrange(25)))
    return rows


SCHEMA = "i long, y double, x double, z double, a string, b string, g long"


def dense(rows, numeric, blocks):
    cols = [np.ones(len(rows)), *[np.array([r[i] for r in rows], float) for i in numeric]]
    for i in blocks:
        cols += [np.array([r[i] == level for r in rows], float) for level in sorted({r[i] for r in rows})[1:]]
    design, y = np.column_stack(cols), np.array([r[1] for r in rows])
    beta, _, rank, _ = np.linalg.lstsq(design, y, rcond=None)
    sse, sst = ((y - design @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    n = len(rows)
    return design @ beta, rank, 1 - sse / sst, 1 - (sse / (n - rank)) / (sst / (n - 1)), math.sqrt(sse / (n - rank))


def test_nested_blocks_as_dense_least_squares(spark):
    rows = cases(400)
    df = spark.createDataFrame(rows, SCHEMA)
    steps = [("x", ["x"], []), ("a", ["x"], ["a"]), ("ab", ["x", "z"], ["a", "b"]), ("none", [], ["b"])]
    got = M.ladder(df, "y", steps).orderBy("step").collect()
    for r, (numeric, blocks) in zip(got, [([2], []), ([2], [4]), ([2, 3], [4, 5]), ([], [5])], strict=True):
        _, rank, *fit = dense(rows, numeric, blocks)
        assert (r.n, r.rank) == (400, rank) and [r.r2, r.r2_adj, r.sd] == pytest.approx(fit)
    fitted = {r.i: r.p for r in M.least_squares(df, "y", ["x", "z"], ["a", "b"]).predicted(df, "p").collect()}
    assert [fitted[i] for i in range(400)] == pytest.approx(list(dense(rows, [2, 3], [4, 5])[0]))


def test_columns_implied_by_others(spark):
    rows = cases(120)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x2", F.col("x") * 2 + 1).withColumn("a2", F.upper("a")).withColumn("one", F.lit("same"))
    f = M.least_squares(df, "y", ["x", "x2"], ["a", "a2", "one"])
    _, rank, r2, r2_adj, sd = dense(rows, [2], [4])
    assert f.rank == rank and [f.r2, f.r2_adj, f.sd] == pytest.approx([r2, r2_adj, sd])
    empty = M.least_squares(df.limit(0), "y", ["x"], ["a"])
    assert (empty.n, empty.r2) == (0, None) and empty.predicted(df.limit(1), "p").first().p is None
    one = M.least_squares(df.limit(1), "y", ["x"], ["a"])
    assert (one.n, one.r2, one.sd) == (1, None, None)


def test_forecast_leaves_unseen_levels_out(spark):
    rows = cases(300)
    train, test = [r for r in rows if r[0] < 200 and r[4] != "s"], [r for r in rows if r[0] >= 200]
    got = M.forecast(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), "y", ["x"], ["a", "b"])
    kept = [r for r in test if r[4] != "s"]
    both, y = train + kept, np.array([r[1] for r in kept])
    cols = np.column_stack([np.ones(len(both)), [r[2] for r in both], *[[r[4] == k for r in both] for k in "qr"], *[[r[5] == k for r in both] for k in "vw"]]).astype(float)
    beta = np.linalg.lstsq(cols[: len(train)], np.array([r[1] for r in train]), rcond=None)[0]
    p, mean = cols[len(train) :] @ beta, np.mean([r[1] for r in train])
    assert (got["n_train"], got["n_test"], got["n_dropped"]) == (len(train), len(kept), len(test) - len(kept))
    assert got["r2_out"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - mean) ** 2).sum())


def test_absorbed_key_is_a_constant_each(spark):
    rows = cases(500)
    f = M.absorbed(spark.createDataFrame(rows, SCHEMA), "y", ["x", "z"], ["g"])
    fitted, rank, *_ , sd = dense(rows, [2, 3], [6])
    assert f.rank == rank and f.sd == pytest.approx(sd)
    deep = M.least_squares(spark.createDataFrame(rows, SCHEMA), "y", ["x", "z"], ["g"])
    assert f.beta == pytest.approx(deep.beta[1:3])


def test_quantile_lines_as_the_best_vertex(spark):
    rows = [(r[1], r[2], r[3]) for r in cases(36, 4)]
    y, design = np.array([r[0] for r in rows]), np.array([[1, r[1], r[2]] for r in rows])
    got = M.quantile_lines(spark.createDataFrame(rows, "y double, x double, z double").coalesce(2), "y", ["x", "z"], (0.25, 0.5), sharp=1e-6)
    for tau, (beta, loss, plain) in got.items():
        check = lambda b, tau=tau: np.where(y >= design @ b, tau * (y - design @ b), (tau - 1) * (y - design @ b)).sum()
        best = min(check(np.linalg.solve(design[list(s)], y[list(s)])) for s in itertools.combinations(range(len(y)), 3))
        assert plain == pytest.approx(min(check(np.array([c, 0, 0])) for c in y))
        assert loss == pytest.approx(best, rel=1e-5) and check(np.array(beta)) == pytest.approx(best, rel=1e-5)


@pytest.mark.parametrize("values", [[1.0], [5.0] * 40, [float(i * i % 97) for i in range(500)], [10.0**i for i in range(-9, 9, 2)] + [-1e30, 0.0, -0.0], [1.0] * 900 + [2.0, 1e12]])
def test_exact_quantiles(spark, values):
    rows = [(k, v + k) for k in (0, 1) for v in values] + [(0, None), (0, float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    cuts = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = Q.exact_quantiles(df, ["k"], "x", cuts)
    want = {(r[0],): r[1] for r in df.where("not isnan(x)").groupBy("k").agg(F.percentile("x", F.array(*[F.lit(c) for c in cuts]))).collect()}
    assert {k: q for k, (_, q) in got.items()} == want and got[(0,)][0] == len(values)


def test_bins_of_an_empty_and_a_tied_column(spark):
    assert Q.bins_by_edges(spark.createDataFrame([], "x double"), "x", 4, "bin").count() == 0
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,), (None,)], "x double")
    assert sorted((r.x or 0.0, r.bin) for r in Q.bins_by_edges(df, "x", 4, "bin").distinct().collect()) == [(0.0, None), (1.0, 0), (2.0, 0), (3.0, 0)]


def star(rng, cx, cy, size, n):
    far = [size * rng.uniform(0.3, 1) for _ in range(n)]
    corners = [(cx + r * math.cos(2 * math.pi * i / n + 0.1), cy + r * math.sin(2 * math.pi * i / n + 0.1)) for i, r in enumerate(far)]
    return corners[:: rng.choice([1, -1])]


def polygon(rng):
    cx, cy = rng.uniform(-30, 30), rng.uniform(-30, 30)
    rings = [star(rng, cx, cy, rng.uniform(8, 20), rng.randint(8, 14)), [(cx + 0.5, cy + 0.5), (cx + 1.7, cy + 0.6), (cx + 1.1, cy + 1.6)][:: rng.choice([1, -1])]]
    return rings + [star(rng, cx + 50, cy, rng.uniform(4, 9), 7)] if rng.random() < 0.5 else rings


def scanned(a, b, lines=400):
    """Common ground by scan lines."""
    ys = [y for p in (a, b) for r in p for _, y in r]
    step, total = (max(ys) - min(ys)) / lines, 0.0
    for i in range(lines):
        y = min(ys) + (i + 0.5) * step
        cuts = [sorted(ax + (bx - ax) * (y - ay) / (by - ay) for r in p for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True) if (ay > y) != (by > y)) for p in (a, b)]
        for u, v in itertools.product(range(0, len(cuts[0]), 2), range(0, len(cuts[1]), 2)):
            total += max(0.0, min(cuts[0][u + 1], cuts[1][v + 1]) - max(cuts[0][u], cuts[1][v])) * step
    return total


def layer(spark, polygons, key):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for i, p in enumerate(polygons)]
    return spark.createDataFrame(rows, f"{key} long, rings array<array<struct<x:double,y:double>>>")


def test_concave_layers_in_parts_with_holes(spark):
    rng = random.Random(3)
    left, right = [polygon(rng) for _ in range(12)], [polygon(rng) for _ in range(9)]
    got = {(r.lid, r.rid): r.area for r in G.overlaps(layer(spark, left, "lid"), layer(spark, right, "rid"), 10.0).collect()}
    assert len(got) > 20
    for i, j in itertools.product(range(12), range(9)):
        assert got.get((i, j), 0.0) == pytest.approx(scanned(left[i], right[j]), rel=0.02, abs=0.02)
    own = {r.lid: r.area for r in G.overlaps(layer(spark, left, "lid"), layer(spark, left, "rid"), 10.0).where("lid = rid").collect()}
    whole = {r.lid: r.a for r in layer(spark, left, "lid").select("lid", G.rings_area(F.col("rings")).alias("a")).collect()}
    assert own == pytest.approx(whole)


def test_weights_of_a_crosswalk_sum_to_one(spark):
    rng = random.Random(8)
    parts = [polygon(rng) for _ in range(10)]
    squares = [[[(x, y), (x + 15, y), (x + 15, y + 15), (x, y + 15)]] for x in range(-45, 45, 15) for y in range(-45, 30, 15)]
    w = G.crosswalk(layer(spark, parts, "lid"), layer(spark, squares, "rid"), 15.0)
    sums = {r.lid: r.w for r in w.groupBy("lid").agg(F.sum("weight").alias("w")).collect()}
    assert sums == pytest.approx(dict.fromkeys(range(10), 1.0)) and w.where("rid is null").count() > 0
