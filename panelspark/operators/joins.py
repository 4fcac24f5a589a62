"""Linkage joins: cascading, interval, as-of, nearest, set-overlap and rule joins.

All are equi joins with a residual condition and an aggregation, so Catalyst picks the physical join and AQE splits skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unique_key(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of keys that have one distinct value: (key, value). An ambiguous key matches none."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


def cascade_join(left: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], value: str, how: str = "how") -> DataFrame:
    """left with `value` from the first tier whose key matches, and that tier's name.

    A tier is (name, lookup, key columns); a lookup has one row a key and the value. Unmatched rows get null and "none".
    """
    out, found = left, []
    for name, lookup, key in tiers:
        column = f"__{name}"
        out = out.join(lookup.select(*key, F.col(value).alias(column)), key, "left")
        found.append((name, column))
    label = reduce(lambda acc, x: F.when(F.col(x[1]).isNotNull(), F.lit(x[0])).otherwise(acc), reversed(found), F.lit("none"))
    return out.withColumn(how, label).withColumn(value, F.coalesce(*[F.col(c) for _, c in found])).drop(*[c for _, c in found])


def interval_join(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Rows of equal keys whose time lies within [at - before, at + after] days.

    Time falls into buckets as wide as the window, which join the key: rows of a busy key meet those near in time alone. A
    left row is in one bucket; a right one goes to the one or two where it may be looked for.
    """
    width = before + after + 1
    bucket = lambda day: F.floor(day / F.lit(width))
    l = left.withColumn("__bucket", bucket(F.unix_date(F.to_date(at))))
    low, high = bucket(F.unix_date(F.to_date(time)) - after), bucket(F.unix_date(F.to_date(time)) + before)
    r = right.withColumn("__bucket", F.explode(F.array_distinct(F.array(low, high))))
    near = F.datediff(r[time], l[at]).between(-before, after)
    joined = l.join(r, reduce(lambda a, b: a & b, [*[l[k] == r[k] for k in (*on, "__bucket")], near]), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bucket")
    return reduce(lambda d, k: d.drop(r[k]), on, joined).drop("__bucket")


def nearest_k(pairs: DataFrame, key: list[str], gap: Column, ties: list[str], k: int = 1) -> DataFrame:
    """The k rows of each key of the smallest absolute gap, with `rank`."""
    order = W.partitionBy(*key).orderBy(F.abs(gap), *ties)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merged(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str, value: Column) -> DataFrame:
    """Rows of both sides under one clock: keys, __t, __left (the left row, else null), __right (struct of the right value, else null)."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    l = left.select(*on, F.col(at).alias("__t"), row.alias("__left"))
    r = right.select(*on, F.col(time).alias("__t"), F.struct(value.alias("v")).alias("__right"))
    named = reduce(lambda d, k: d.where(F.col(k).isNotNull()), on, r)
    return l.unionByName(named, allowMissingColumns=True)


def next_event(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str) -> DataFrame:
    """left with `next`, the first time of right on or after `at`, and `last`, the latest of all its times. One sort of both sides by key and time: no pairs of rows are made."""
    both = _merged(left, right.where(F.col(time).isNotNull()), on, at, time, F.col(time))
    key = W.partitionBy(*on)
    ahead = key.orderBy(F.asc_nulls_first("__t"), F.col("__left").isNull()).rowsBetween(W.currentRow, W.unboundedFollowing)
    out = both.withColumn("next", F.when(F.col("__t").isNotNull(), F.min("__right.v").over(ahead))).withColumn("last", F.max("__right.v").over(key))
    return out.where("__left is not null").select("__left.*", "next", "last")


def latest_before(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str, value: str) -> DataFrame:
    """left with the value of right's latest row of time at most `at`, the largest of ties; a null time counts as earliest. One sort of both sides by key and time."""
    both = _merged(left, right, on, at, time, F.col(value))
    so_far = W.partitionBy(*on).orderBy(F.asc_nulls_first("__t"), F.col("__left").isNotNull(), F.asc_nulls_first("__right")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(so_far))
    return out.where("__left is not null").select("__left.*", F.col("__seen.v").alias(value))


def clamp(year: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(year, low), high)


def modal(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """(key, out): the most frequent value of each key, the smallest of ties; null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def latest_wins(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the order given."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def overlap_flags(items: DataFrame, layer: DataFrame, key: str, element: str, flags: dict[str, Column]) -> DataFrame:
    """(key, flags...): whether any element of a key's set is in the layer and fulfils each condition."""
    joined = items.select(key, element).join(layer, element, "left")
    return joined.groupBy(key).agg(*[F.coalesce(F.bool_or(condition), F.lit(False)).alias(name) for name, condition in flags.items()])


def first_rule(df: DataFrame, text: str, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """`out`: the label of the first rule (regex, label) that the text matches; null where none does."""
    label = reduce(lambda acc, r: F.when(F.coalesce(F.col(text).rlike(r[0]), F.lit(False)), F.lit(r[1])).otherwise(acc), reversed(rules), F.lit(None).cast("string"))
    return df.withColumn(out, label)


def rules_of_list(df: DataFrame, text: str, rules: list[tuple[str, str, str]], separator: str = "; ", labels: str = "labels", notes: str = "notes") -> DataFrame:
    """df with the labels and notes of a list in one column: each element takes the first rule (regex, label, note) that it matches, or none.

    Both are sorted without repeats, a blank note left out; an empty or null list has empty ones. No row is copied: a list is looked through in place.
    """
    none = F.lit(None).cast("struct<label:string,note:string>")

    def first(element: Column) -> Column:
        return reduce(lambda acc, r: F.when(element.rlike(r[0]), F.struct(F.lit(r[1]).alias("label"), F.lit(r[2]).alias("note"))).otherwise(acc), reversed(rules), none)

    told = F.array_compact(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\\Q" + separator + "\\E"), first))
    sorted_of = lambda part: F.array_sort(F.array_distinct(F.transform("__told", lambda x: x[part])))
    return df.withColumn("__told", told).withColumn(labels, sorted_of("label")).withColumn(notes, F.filter(sorted_of("note"), lambda n: n != "")).drop("__told")


def panel_years(df: DataFrame, first: str, last: str, year: str = "year") -> DataFrame:
    """One row for each year from first to last, both included; none where the span is empty or null."""
    return df.withColumn(year, F.explode(F.when(F.col(first) <= F.col(last), F.sequence(F.col(first), F.col(last)))))


def ever_since(df: DataFrame, key: list[str], order: list, value: str) -> Column:
    """The latest non-null value so far."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def chase(df: DataFrame, node: str, to: str, hops: int = 5) -> DataFrame:
    """df with `end` and `hops`: where following `to` leads within so many steps. Steps end at a node without `to`, or before a node met already."""
    links = df.select(F.col(node).alias("__n"), F.col(to).alias("__t"))
    out = df.withColumn("end", F.col(node)).withColumn("hops", F.lit(0)).withColumn("__met", F.array(node))
    for _ in range(hops):
        out = out.join(links, out["end"] == links["__n"], "left")
        out = out.withColumn("__go", F.col("__t").isNotNull() & ~F.array_contains("__met", F.coalesce("__t", "end")))
        out = out.withColumn("hops", F.col("hops") + F.col("__go").cast("int")).withColumn("__met", F.when(F.col("__go"), F.array_append("__met", F.col("__t"))).otherwise(F.col("__met")))
        out = out.withColumn("end", F.when(F.col("__go"), F.col("__t")).otherwise(F.col("end"))).drop("__n", "__t", "__go")
    return out.drop("__met")
