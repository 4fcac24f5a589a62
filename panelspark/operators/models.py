"""Linear models over tables of any length: categorical blocks, absorbed keys, forecasts and quantile lines.

Every fit is a few sums: the rows are aggregated by Spark and the driver solves as many equations as there are
coefficients, of which there are at most MOST_TERMS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.quantiles import exact_quantiles

#: Coefficients of one model, constant and levels included.
MOST_TERMS = 2_000


@dataclass
class Fit:
    """A model of y on a constant, numeric columns and categorical blocks; the first level of a block, in order, is its base."""

    y: str
    numeric: list[str]
    blocks: list[str]
    names: list[str] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)
    levels: dict[str, dict] = field(default_factory=dict)
    n: int = 0
    rank: int = 0
    mean: float | None = None
    r2: float | None = None
    r2_adj: float | None = None
    sd: float | None = None

    def coefficient(self, name: str) -> float:
        return self.beta[self.names.index(name)]

    def predicted(self, df: DataFrame, out: str) -> DataFrame:
        """df with `out`; null where a number is missing or a level was unseen when the model was fitted. Levels meet the rows in broadcast tables of at most MOST_TERMS rows."""
        total: Column = F.lit(self.beta[0] if self.beta else None).cast("double")
        for i, x in enumerate(self.numeric, 1):
            total = total + F.col(x).cast("double") * F.lit(self.beta[i] if self.beta else 0.0)
        for b in self.blocks:
            known = df.sparkSession.createDataFrame(list(self.levels.get(b, {}).items()), f"__level_{b} string, __beta_{b} double")
            df = df.join(F.broadcast(known), F.col(b).cast("string") == F.col(f"__level_{b}"), "left")
            total = total + F.col(f"__beta_{b}")
        return df.withColumn(out, total).drop(*[f"__{k}_{b}" for b in self.blocks for k in ("level", "beta")])


def least_squares(df: DataFrame, y: str, numeric: list[str] = (), blocks: list[str] = ()) -> Fit:
    """Ordinary least squares; rows with a null in any column are left out.

    Rows become cells of levels with sums of products, then every pair of blocks is summed from the cells in one pass of
    grouping sets: what reaches the driver is the matrix of the equations. Columns that others imply are dropped from the
    right, as the rank of the matrix says, so degrees of freedom are those of the columns that count.
    """
    numeric, blocks = list(numeric), list(blocks)
    out = Fit(y, numeric, blocks)
    needed = [y, *numeric, *blocks]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in needed)).select(*[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate([y, *numeric])], *[F.col(b).cast("string").alias(f"b{i}") for i, b in enumerate(blocks)])
    values, keys = [f"n{i}" for i in range(len(numeric) + 1)], [f"b{i}" for i in range(len(blocks))]
    pairs = list(combinations_with_replacement(values, 2))
    sums = [F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]]
    if keys:
        added = [F.sum(c).alias(c) for c in ("n", *values, *(f"{a}_{b}" for a, b in pairs))]
        sets = [[], *[[k] for k in keys], *[[a, b] for i, a in enumerate(keys) for b in keys[i + 1 :]]]
        cells = rows.groupBy(*keys).agg(*sums)
        table = cells.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*[F.grouping(k).alias(f"g{k}") for k in keys], *added)
        most = MOST_TERMS * (MOST_TERMS + 1) // 2
        met = table.limit(most + 1).collect()
        if len(met) > most:
            raise ValueError(f"levels meet in more than {most} pairs: absorb the largest block")
    else:
        met = rows.agg(*sums).collect()
    by_set: dict[tuple, dict] = {}
    for r in met:
        here = tuple(k for k in keys if not r[f"g{k}"])
        by_set.setdefault(here, {})[tuple(r[k] for k in here)] = r
    whole = by_set.get((), {}).get(())
    if whole is None or not whole["n"]:
        return out
    levels = {k: sorted(key[0] for key in by_set[(k,)]) for k in keys}
    terms = [("1", None), *[(v, None) for v in values[1:]], *[(k, level) for k in keys for level in levels[k][1:]]]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} coefficients, at most {MOST_TERMS}: absorb the largest block")
    # Of two numbers, of a number and a level, of two levels.
    product = lambda r, a, b: r["n"] if a == b == "1" else r[b] if a == "1" else r[a] if b == "1" else r["_".join(sorted((a, b)))]
    m, v = np.zeros((len(terms), len(terms))), np.zeros(len(terms))
    for i, (a, la) in enumerate(terms):
        own = whole if la is None else by_set[(a,)][(la,)]
        v[i] = product(own, "1" if la is not None else a, "n0")
        for j, (b, lb) in enumerate(terms[: i + 1]):
            if la is None:
                m[i, j] = product(whole, a, b)
            elif lb is None:
                m[i, j] = product(own, "1", b)
            elif a == b:
                m[i, j] = own["n"] if la == lb else 0.0
            else:
                r = by_set[tuple(sorted((a, b), key=keys.index))].get(tuple(x for _, x in sorted(((a, la), (b, lb)), key=lambda t: keys.index(t[0]))))
                m[i, j] = r["n"] if r else 0.0
            m[j, i] = m[i, j]
    beta, kept = _solved(m, v)
    out.names = ["1", *numeric, *[f"{blocks[keys.index(k)]}={level}" for k, level in terms[1 + len(numeric) :]]]
    out.beta = beta.tolist()
    out.levels = {b: {levels[k][0]: 0.0} | {level: out.coefficient(f"{b}={level}") for level in levels[k][1:]} for b, k in zip(blocks, keys, strict=True)}
    out.n, out.rank, out.mean = int(whole["n"]), len(kept), whole["n0"] / whole["n"]
    _measured(out, whole["n0_n0"] - beta @ v, whole["n0_n0"] - whole["n0"] ** 2 / whole["n"], out.n - out.rank, out.n - 1)
    return out


def _solved(m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Coefficients, and the columns that are not implied by those before them; the others get 0."""
    size = np.sqrt(np.maximum(np.diag(m), 1e-300))
    scaled = m / size[:, None] / size[None, :]
    kept: list[int] = []
    left = scaled.copy()
    for i in range(len(m)):
        if left[i, i] > 1e-10 * max(1.0, scaled[i, i]):
            kept.append(i)
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
    beta = np.zeros(len(m))
    if kept:
        beta[kept] = np.linalg.solve(scaled[np.ix_(kept, kept)], (v / size)[kept]) / size[kept]
    return beta, kept


def _measured(fit: Fit, sse: float, sst: float, free: int, whole_free: int) -> None:
    sse = max(float(sse), 0.0)
    fit.r2 = 1 - sse / sst if sst > 0 else None
    fit.sd = float(np.sqrt(sse / free)) if free > 0 else None
    fit.r2_adj = 1 - (sse / free) / (sst / whole_free) if sst > 0 and free > 0 else None


def ladder(df: DataFrame, y: str, steps: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(step, name, n, rank, r2, r2_adj, sd) of nested models (name, numeric, blocks), each on the rows that have its own columns."""
    rows = []
    for i, (name, numeric, blocks) in enumerate(steps):
        f = least_squares(df, y, numeric, blocks)
        rows.append((i, name, f.n, f.rank, f.r2, f.r2_adj, f.sd))
    return df.sparkSession.createDataFrame(rows, "step int, name string, n long, rank int, r2 double, r2_adj double, sd double")


def absorbed(df: DataFrame, y: str, numeric: list[str], key: list[str]) -> Fit:
    """Least squares with a constant for each value of key, of which there may be any number: sums within a key, then one row of totals. r2 is that within keys."""
    out = Fit(y, list(numeric), [])
    names = [y, *numeric]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*names, *key])).select(*key, *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(names)])
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    # Centred sums a key: its own means are near its values, where those of the table may be far.
    within = rows.groupBy(*key).agg(F.count("*").alias("n"), *[(F.covar_pop(f"n{i}", f"n{j}") * F.count("*")).alias(f"c{i}_{j}") for i, j in pairs])
    one = within.agg(F.sum("n").alias("n"), F.count("*").alias("k"), *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not one["n"]:
        return out
    c = lambda i, j: one[f"c{min(i, j)}_{max(i, j)}"]
    m = np.array([[c(i, j) for j in range(1, len(names))] for i in range(1, len(names))]).reshape(len(numeric), len(numeric))
    v = np.array([c(0, i) for i in range(1, len(names))])
    beta, kept = _solved(m, v)
    out.names, out.beta, out.n, out.rank = list(numeric), beta.tolist(), int(one["n"]), len(kept) + one["k"]
    _measured(out, c(0, 0) - beta @ v, c(0, 0), out.n - out.rank, out.n - one["k"])
    return out


def forecast(train: DataFrame, test: DataFrame, y: str, numeric: list[str], blocks: list[str], clip: tuple[float, float] | None = None) -> dict:
    """Fitted on train, tried on test: n_train, n_test, n_dropped (rows of a level unseen in training), r2_in, r2_out against the mean of training, mean_out."""
    fit = least_squares(train, y, numeric, blocks)
    tried = fit.predicted(test.where(F.col(y).isNotNull()), "__p")
    p = F.least(F.greatest(F.col("__p"), F.lit(clip[0])), F.lit(clip[1])) if clip else F.col("__p")
    seen = F.col("__p").isNotNull()
    one = tried.agg(
        F.count_if(seen).alias("n"), F.count_if(~seen).alias("dropped"), F.avg(F.when(seen, F.col(y))).alias("mean"),
        F.sum(F.when(seen, F.pow(F.col(y) - p, F.lit(2)))).alias("sse"), F.sum(F.when(seen, F.pow(F.col(y) - F.lit(fit.mean), F.lit(2)))).alias("sst"),
    ).first()
    return {"n_train": fit.n, "n_test": one["n"], "n_dropped": one["dropped"], "r2_in": fit.r2, "r2_out": 1 - one["sse"] / one["sst"] if one["sst"] else None, "mean_out": one["mean"]}


@dataclass
class Surface:
    """A constant for each cell, absorbed, and slopes fitted within cells."""

    fit: Fit
    y: str
    numeric: list[str]
    cell: list[str]
    cells: DataFrame
    means: list[float]

    def predicted(self, df: DataFrame, out: str) -> DataFrame:
        """df with `out`: the mean of y in the row's cell, and how far the row's numbers stand from those of the cell; a cell without rows when fitted takes the means of all. Null where a number is missing."""
        met = df.join(self.cells, self.cell, "left")
        value = F.coalesce("__m0", F.lit(self.means[0]))
        for i, (x, beta) in enumerate(zip(self.numeric, self.fit.beta, strict=True), 1):
            value = value + (F.col(x).cast("double") - F.coalesce(f"__m{i}", F.lit(self.means[i]))) * F.lit(beta)
        return met.withColumn(out, value).drop(*[f"__m{i}" for i in range(len(self.numeric) + 1)])


def surface(df: DataFrame, y: str, numeric: list[str], cell: list[str]) -> Surface | None:
    """The surface of the rows that have all columns; None without any. Cells are a table that meets others by its key, however many there are."""
    names = [y, *numeric]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*names, *cell]))
    averages = [F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(names)]
    means = rows.agg(*averages).first()
    if means[0] is None:
        return None
    return Surface(absorbed(rows, y, numeric, cell), y, list(numeric), list(cell), rows.groupBy(*cell).agg(*averages), list(means))


def surface_scores(df: DataFrame, y: str, numeric: list[str], cell: list[str], held: Column) -> DataFrame:
    """One row for a surface fitted on the rows that are not held out and tried on the others: n_train, n_test, n_no_cell (tried rows of a cell unseen), rmse, r2 about the tried rows' own mean, bias."""
    made = surface(df.where(~held), y, numeric, cell)
    if made is None:
        return df.sparkSession.createDataFrame([], "n_train long, n_test long, n_no_cell long, rmse double, r2 double, bias double")
    seen = made.cells.select(*cell, F.lit(1).alias("__seen"))
    tried = made.predicted(df.where(held & F.col(y).isNotNull()), "__p").where("__p is not null").join(seen, cell, "left")
    error = F.col(y) - F.col("__p")
    one = tried.agg(F.count("*").alias("n_test"), F.count_if(F.col("__seen").isNull()).alias("n_no_cell"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.avg(error * error) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), F.avg(error).alias("bias"))
    return one.select(F.lit(made.fit.n).cast("long").alias("n_train"), "*")


def observed_or_imputed(panel: DataFrame, observed: DataFrame, made: Surface, key: list[str], out: str) -> DataFrame:
    """panel with `out` and `imputed`: the mean of what is observed (key, y) for a row's key, else what the surface says."""
    seen = observed.where(F.col(made.y).isNotNull()).groupBy(*key).agg(F.avg(made.y).alias("__seen"))
    both = made.predicted(panel.join(seen, key, "left"), "__p")
    return both.withColumn(out, F.coalesce("__seen", "__p")).withColumn("imputed", F.col("__seen").isNull()).drop("__seen", "__p")


#: How much of the plain curvature a round adds to that within the band, from a Newton step to a short one down the slope; and how far a band that has settled shrinks.
ADDED, SHRINK = (1e-9, 1e-4, 1e-2, 0.3, 10.0, 1e3), 4.0


def quantile_lines(df: DataFrame, y: str, numeric: list[str], taus: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), rounds: int = 200, sharp: float = 1e-7) -> dict[float, tuple[list[float], float, float]]:
    """{tau: (coefficients, constant first; check loss; loss of the constant alone)} of quantile regression on several columns.

    Newton steps on the check loss with its corner rounded over a band: a round tries steps of several lengths for each tau
    and returns their losses, slopes and curvatures, sums that Spark adds up whatever the rows. Once a step promises less than the
    rounding costs, the band shrinks, down to `sharp` standard deviations of y. Rows with a null are left out.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *numeric])).select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([y, *numeric])]).persist()
    try:
        whole = rows.agg(F.count("*"), F.stddev_pop("c0"), *[F.sqrt(F.avg(F.col(f"c{i}") * F.col(f"c{i}"))) for i in range(1, len(numeric) + 1)]).first()
        if not whole[0]:
            return {t: ([], 0.0, 0.0) for t in taus}
        n, scale = whole[0], whole[1] or 1.0
        size = np.array([1.0, *[s or 1.0 for s in whole[2:]]])
        fit = least_squares(rows, "c0", [f"c{i}" for i in range(1, len(numeric) + 1)])
        lines = _settled(rows, {t: np.array(fit.beta) * size + np.eye(len(size))[0] * (fit.sd or 0.0) * np.sqrt(2) * _erfinv(2 * t - 1) for t in taus}, size, n, scale, rounds, sharp)
        cuts = exact_quantiles(rows, [], "c0", tuple(taus))[()][1]
        plain = _looked(rows, [(t, 0.0, np.array([c])) for t, c in zip(taus, cuts, strict=True)], size[:1])
        return {t: ((lines[t][0] / size).tolist(), lines[t][1], plain[i][0]) for i, t in enumerate(taus)}
    finally:
        rows.unpersist()


def _settled(rows: DataFrame, at: dict[float, np.ndarray], size: np.ndarray, n: int, scale: float, rounds: int, sharp: float) -> dict[float, tuple[np.ndarray, float]]:
    """Each tau's coefficients, of columns of size 1, and check loss, from where `at` begins."""
    k = len(size)
    band, steps = dict.fromkeys(at, scale), {t: [np.zeros(k)] for t in at}
    open_, state = set(at), {}
    for _ in range(rounds):
        if not open_:
            break
        tries = [(t, band[t], at[t] + step) for t in sorted(open_) for step in steps[t]]
        seen = _looked(rows, tries, size)
        for t in sorted(open_):
            best, place = min(((seen[i], tries[i][2]) for i in range(len(tries)) if tries[i][0] == t), key=lambda o: o[0][0])
            stuck = t in state and best[0] >= state[t][0]
            if not stuck:
                at[t], state[t] = place, best
            _, slope, curve = state[t]
            steps[t] = [np.linalg.solve(curve + a * n / scale * np.eye(k), slope) for a in (*ADDED, scale / band[t])]
            if stuck or slope @ steps[t][0] <= 1e-4 * band[t] * n:
                if band[t] <= sharp * scale:
                    open_.discard(t)
                else:
                    band[t] = max(band[t] / SHRINK, sharp * scale)
                    steps[t] = [np.zeros(k)]
                    state.pop(t)
    losses = _looked(rows, [(t, 0.0, at[t]) for t in at], size)
    return {t: (at[t], losses[i][0]) for i, t in enumerate(at)}


def _looked(rows: DataFrame, tries: list[tuple[float, float, np.ndarray]], size: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, downward slope and curvature of every try (tau, band, coefficients), added up over all rows."""
    k = len(size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tries), 1 + k + k * k))
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False)
            design = np.column_stack([np.ones(len(target)), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, k)]]) / size
            for i, (tau, h, beta) in enumerate(tries):
                r = target - design @ beta
                flat = np.abs(r) <= h
                loss = np.where(r > 0, tau * r, (tau - 1) * r)
                slope = np.where(r > 0, tau, tau - 1.0)
                if h:
                    loss = np.where(flat, r * r / (4 * h) + h / 4 + (tau - 0.5) * r, loss)
                    slope = np.where(flat, tau - 0.5 + r / (2 * h), slope)
                    total[i, 1 + k :] += (design[flat].T @ design[flat] / (2 * h)).ravel()
                total[i, 0] += loss.sum()
                total[i, 1 : 1 + k] += design.T @ slope
        places = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel())], names=["place", "part"])

    narrow = rows.select(*rows.columns[:k])
    sums = narrow.mapInArrow(summed, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()
    out = np.zeros(len(tries) * (1 + k + k * k))
    for place, s in sums:
        out[place] = s
    return [(float(o[0]), o[1 : 1 + k], o[1 + k :].reshape(k, k)) for o in out.reshape(len(tries), -1)]


def _erfinv(x: float) -> float:
    """Inverse error function by Newton steps."""
    from math import erf, exp, pi, sqrt

    z = 0.0
    for _ in range(60):
        z -= (erf(z) - x) / (2 / sqrt(pi) * exp(-z * z))
    return z
