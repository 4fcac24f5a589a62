"""Exact quantiles of large groups by rounds of counts: no task ever holds the values of a group.

A round splits what is still open of each group into equal stretches and counts each: one aggregation whose partial rows
are a stretch a task. An order statistic lies in the stretch where the running count passes it; the next round splits that
stretch between its least and greatest value alone. Data that are spread evenly settle in two or three rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Stretches of a group that a round counts, and groups that may be asked for at once: the driver keeps a row for each open stretch.
STRETCHES, MOST_GROUPS = 512, 20_000


def exact_quantiles(df: DataFrame, keys: list[str], x: str, quantiles: tuple[float, ...], rounds: int = 200) -> dict[tuple, tuple[int, list[float]]]:
    """{key values: (n, quantiles)} of the finite values of x by linear interpolation between order statistics; groups without any are left out.

    For few, large groups. A table of very many small groups is served by F.percentile, whose state is then small.
    """
    value = F.col(x).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(*keys, value.alias("__x"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")).limit(MOST_GROUPS + 1).collect()
    if len(ends) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: use F.percentile, as groups are small")
    sizes = {tuple(r[k] for k in keys): r["n"] for r in ends}
    found: dict[tuple, float] = {}
    open_: dict[tuple, set[int]] = {}  # (key, low, high, values below) -> places of order statistics in it
    for r in ends:
        key = tuple(r[k] for k in keys)
        wanted = {i for q in quantiles for i in _places(r["n"], q)}
        _place(found, open_, key, r["low"], r["high"], 0, wanted)
    schema = StructType([*rows.select(*keys).schema.fields, StructField("__t", IntegerType()), StructField("__low", DoubleType()), StructField("__high", DoubleType())])
    for _ in range(rounds):
        if not open_:
            break
        targets = list(open_)
        frame = df.sparkSession.createDataFrame([(*key, i, low, high) for i, (key, low, high, _) in enumerate(targets)], schema)
        inside = (F.col("__x") >= F.col("__low")) & (F.col("__x") <= F.col("__high"))
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(frame[k])
        # At most MOST_GROUPS targets a quantile; each meets its own group's rows alone.
        met = rows.join(F.broadcast(frame), same & inside).select("__t", "__x", "__low", "__high")
        width = (F.col("__high") - F.col("__low")) / STRETCHES
        part = F.least(F.floor((F.col("__x") - F.col("__low")) / width), F.lit(STRETCHES - 1))
        counts = met.groupBy("__t", part.alias("__p")).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        stretches: dict[int, list] = {}
        for r in counts.collect():
            stretches.setdefault(r["__t"], []).append((r["low"], r["high"], r["n"]))
        following: dict[tuple, set[int]] = {}
        for t, target in enumerate(targets):
            below = target[3]
            for low, high, n in sorted(stretches[t]):
                here = {i for i in open_[target] if below <= i < below + n}
                _place(found, following, target[0], low, high, below, here)
                below += n
        open_ = following
    if open_:
        raise RuntimeError(f"quantiles have not settled after {rounds} rounds")
    return {key: (n, [_between(found, key, n, q) for q in quantiles]) for key, n in sizes.items()}


def _places(n: int, q: float) -> tuple[int, int]:
    at = q * (n - 1)
    return int(at), min(int(at) + 1, n - 1)


def _place(found: dict, open_: dict, key: tuple, low: float, high: float, below: int, wanted: set[int]) -> None:
    """Places within a stretch of one value are found, others stay open."""
    if not wanted:
        return
    if low == high:
        found.update({(key, i): low for i in wanted})
    else:
        open_[key, low, high, below] = wanted


def _between(found: dict, key: tuple, n: int, q: float) -> float:
    lower, upper = (found[key, i] for i in _places(n, q))
    part = q * (n - 1) - int(q * (n - 1))
    # As Spark's own percentile weighs the neighbours.
    return lower if lower == upper else (1 - part) * lower + part * upper


def quantile_table(df: DataFrame, keys: list[str], x: str, quantiles: tuple[float, ...], names: list[str]) -> DataFrame:
    """exact_quantiles() as a table: the keys and a column a quantile; a row a group, of which there are at most MOST_GROUPS."""
    found = exact_quantiles(df, keys, x, quantiles)
    schema = StructType([*df.select(*keys).schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return df.sparkSession.createDataFrame([(*key, *cuts) for key, (_, cuts) in found.items()], schema)


def bins_by_edges(df: DataFrame, x: str, bins: int, out: str) -> DataFrame:
    """df with `out`, its right-closed bin between quantiles of x from 0 on, equal edges being one; the lowest value is in the first."""
    cuts = exact_quantiles(df, [], x, tuple(i / bins for i in range(bins + 1))).get((), (0, []))[1]
    edges = sorted(set(cuts))[1:-1]
    at: Column = F.lit(0)
    for e in edges:
        at = at + (F.col(x) > F.lit(e)).cast("int")
    return df.withColumn(out, F.when(F.col(x).isNotNull(), at))
