"""Row and calendar windows, runs, folds and interleaving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rolling(x: Column, key: list[str], order: list, before: int, after: int, least: int = 1) -> Column:
    """Mean over rows, null where fewer than `least` values are in the frame."""
    frame = W.partitionBy(*key).orderBy(*order).rowsBetween(-before, after)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def calendar_rolling(x: Column, key: list[str], day: Column, days: int) -> Column:
    """Mean over all rows within so many days before and after."""
    return F.avg(x).over(W.partitionBy(*key).orderBy(day).rangeBetween(-days, days))


def island(key: list[str], order: list, value: Column) -> Column:
    """Number of the run of equal values that a row is in, from 1."""
    w = W.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(w)
    return F.sum(F.when(before.eqNullSafe(value) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def quantile_bin(x: Column, edges: list[Column]) -> Column:
    """Right-closed bins 1.. of ascending edges, lowest edge included; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low = x >= edges[0] if i == 1 else x > edges[i - 1]
        out = F.when(low & (x <= edges[i]), F.lit(i)).otherwise(out)
    return out


def turn(group: list[str], order: list) -> Column:
    """Place within its group: ordering by it, then by group, takes one of each in turn."""
    return F.row_number().over(W.partitionBy(*group).orderBy(*order))


def thinned(sorted_items: Column, gap: int) -> Column:
    """Of ascending (pos, tag) structs, those that do not repeat the tag of the last one kept within `gap`."""
    zero = F.slice(sorted_items, 1, 1)
    return F.aggregate(
        F.slice(sorted_items, 2, F.greatest(F.size(sorted_items), F.lit(1))),
        zero,
        lambda kept, x: F.when((F.element_at(kept, -1)["tag"] == x["tag"]) & (x["pos"] - F.element_at(kept, -1)["pos"] < gap), kept).otherwise(F.concat(kept, F.array(x))),
    )


def rolling_mode(x: Column, key: list[str], order: list, before: int, after: int) -> Column:
    """The most frequent value among so many rows before and after, the first seen of ties."""
    frame = F.collect_list(x).over(W.partitionBy(*key).orderBy(*order).rowsBetween(-before, after))

    def best(values: Column) -> Column:
        # Distinct values stand in the order seen; the first of the largest count wins.
        counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), v.alias("v")))
        return F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v")), lambda a, c: F.when(c["n"] > a["n"], F.struct(c["n"].alias("n"), c["v"].cast("string").alias("v"))).otherwise(a))["v"]

    return F.flatten(F.array(F.transform(F.array(frame), best)))[0]


def absorb(runs: list[list], least: int) -> list[list]:
    """Runs [name, start, end, n] with those shorter than `least` taken over by the longer neighbour, the left one of ties; then neighbours of one name are one."""
    runs = [list(r) for r in runs]
    while len(runs) > 1:
        short = next((i for i, r in enumerate(runs) if r[3] < least), None)
        if short is None:
            break
        near = [runs[i] for i in (short - 1, short + 1) if 0 <= i < len(runs)]
        heir, gone = max(near, key=lambda r: r[3]), runs.pop(short)
        heir[1], heir[2], heir[3] = min(heir[1], gone[1]), max(heir[2], gone[2]), heir[3] + gone[3]
    out: list[list] = []
    for r in runs:
        if out and out[-1][0] == r[0]:
            out[-1][2], out[-1][3] = r[2], out[-1][3] + r[3]
        else:
            out.append(r)
    return out


def terms(df, key: str, order: list[str], value: str, at: str, window: int, least: int):
    """(key, term, name, start, end, n): runs of the rolling mode of a value, short ones absorbed. Runs are cut by Spark; one key's runs, not its rows, meet in a task."""
    import pandas as pd

    smooth = df.where(F.col(value).isNotNull()).withColumn("__mode", rolling_mode(F.col(value), [key], order, window, window))
    runs = smooth.withColumn("__run", island([key], order, F.col("__mode"))).groupBy(key, "__run").agg(F.first("__mode").alias("name"), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__run")
        kept = absorb(pdf[["name", "start", "end", "n"]].values.tolist(), least)
        return pd.DataFrame([(pdf[key].iloc[0], i, *r) for i, r in enumerate(kept)], columns=[key, "term", "name", "start", "end", "n"])

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return runs.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, term int, name string, start {kind[at]}, end {kind[at]}, n long")
