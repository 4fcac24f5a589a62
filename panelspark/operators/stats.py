"""Distributions, weighted statistics, margins, funnels and comparisons of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def distribution(x: Column, quantiles: tuple = QUANTILES) -> list[Column]:
    """n, mean, sd, exact quantiles by linear interpolation, spread of logs and the number of negative values."""
    # One state for all quantiles of a group: Spark keeps equal aggregates once.
    every = sorted({*quantiles, 0.25, 0.75})
    at = F.percentile(x, F.array(*[F.lit(float(q)) for q in every]))
    cut = {q: at[i] for i, q in enumerate(every)}
    cuts = [cut[q].alias(f"p{q * 100:g}") for q in quantiles]
    return [*moments(x), *cuts, (cut[0.75] - cut[0.25]).alias("iqr")]


def moments(x: Column) -> list[Column]:
    """What distribution() has besides quantiles: sums alone, so a group of any size is a small state."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.nullif(F.avg(x), F.lit(0.0))).alias("cv"), F.stddev_samp(F.when(x > 0, F.ln(x))).alias("sd_log"), F.count_if(x < 0).alias("n_negative")]


def weighted(x: Column, w: Column) -> tuple[Column, Column]:
    """Weighted mean and population variance; rows of null x don't count."""
    w = F.when(x.isNotNull(), w)
    mean = F.sum(w * x) / F.sum(w)
    return mean, F.sum(w * x * x) / F.sum(w) - mean * mean


def weighted_quantile(df: DataFrame, key: list[str], x: str, w: str, q: float, out: str) -> DataFrame:
    """(key, out): the smallest x whose cumulative weight reaches the share q of all."""
    sums = df.where(F.col(x).isNotNull()).groupBy(*key, x).agg(F.sum(w).alias("__w"))
    ahead = W.partitionBy(*key)
    run = sums.withColumn("__c", F.sum("__w").over(ahead.orderBy(x))).withColumn("__t", F.sum("__w").over(ahead))
    return run.groupBy(*key).agg(F.min(F.when(F.col("__c") >= q * F.col("__t"), F.col(x))).alias(out))


def cut_moments(df: DataFrame, cuts: list[list[str]], columns: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates for each cut, a list of grouping columns; columns that a cut leaves out read "all"."""
    sets = [[F.col(c) for c in cut] for cut in cuts]
    out = df.groupingSets(sets, *columns).agg(*[F.grouping(c).alias(f"__{c}") for c in columns], *aggregates)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"__{c}") == 1, F.lit("all")).otherwise(F.col(c).cast("string"))).drop(f"__{c}")
    return out


def reweight(df: DataFrame, treated: str, cell: list[str], n: str | None = None) -> DataFrame:
    """df on common support with `weight`: 1 for the treated; for the rest the treated's share of a cell over their own. With n a row stands for as many units."""
    units = lambda side: F.sum(F.when(side, F.col(n) if n else F.lit(1)).otherwise(0))
    counts = df.groupBy(*cell).agg(units(F.col(treated)).alias("__t"), units(~F.col(treated)).alias("__c")).where("__t > 0 and __c > 0")
    both = df.join(counts, cell)
    return both.withColumn("weight", F.when(F.col(treated), F.lit(1.0)).otherwise(F.col("__t") / F.col("__c"))).drop("__t", "__c")


def standardised_difference(df: DataFrame, treated: str, x: str, w: str) -> DataFrame:
    """One row: means, population variances and (m1 - m0) / sqrt((v1 + v0) / 2)."""
    parts = {}
    for name, side in (("1", F.col(treated)), ("0", ~F.col(treated))):
        parts[name] = weighted(F.when(side, F.col(x)), F.when(side, F.col(w)))
    out = df.agg(parts["1"][0].alias("mean_1"), parts["0"][0].alias("mean_0"), parts["1"][1].alias("var_1"), parts["0"][1].alias("var_0"))
    return out.withColumn("std_diff", (F.col("mean_1") - F.col("mean_0")) / F.sqrt((F.col("var_1") + F.col("var_0")) / 2))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], unit: str) -> DataFrame:
    """One row a step, each kept within the last: rows, distinct units, and rows lost since the step before."""
    kept, aggregates = F.lit(True), []
    for i, (_, condition) in enumerate(steps):
        kept = kept & F.coalesce(condition, F.lit(False))
        aggregates += [F.count_if(kept).alias(f"rows_{i}"), F.countDistinct(F.when(kept, F.col(unit))).alias(f"units_{i}")]
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"rows_{i}").alias("n_rows"), F.col(f"units_{i}").alias("n_units"), (F.col(f"rows_{i - 1}") - F.col(f"rows_{i}") if i else F.lit(0).cast("long")).alias("lost")) for i, (name, _) in enumerate(steps)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    def ranks(d: DataFrame, c: str) -> DataFrame:
        counts = d.groupBy(c).agg(F.count("*").alias("__k"))
        at = counts.withColumn(f"__r_{c}", F.sum("__k").over(W.orderBy(c)) - (F.col("__k") - 1) / 2)
        return d.join(at.drop("__k"), c)

    both = ranks(ranks(df.where(f"{x} is not null and {y} is not null").select(x, y), x), y)
    # Null, not an error, where a column is constant.
    linear = lambda a, b: F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return both.agg(linear(f"__r_{x}", f"__r_{y}").alias("spearman"), linear(x, y).alias("pearson"))


def inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows that have a value, distinct values, the most frequent one and its count, and the inferred kind."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    filled = long.where("value is not null and value <> ''")
    counts = filled.groupBy("column", "value").agg(F.count("*").alias("n"))
    kind = (
        F.when(F.avg(F.col("value").rlike(r"^(true|false|yes|no|y|n)$").cast("int") * F.col("n")) / F.avg("n") > 0.95, "flag")
        .when(F.avg(F.col("value").rlike(r"^\d{4}-\d\d-\d\d").cast("int") * F.col("n")) / F.avg("n") > 0.95, "date")
        .when(F.avg(F.col("value").rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?$").cast("int") * F.col("n")) / F.avg("n") > 0.95, "number")
        .when(F.count("*") <= 50, "code")
        .otherwise("text")
    )
    return counts.groupBy("column").agg(F.sum("n").alias("n_filled"), F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"), F.max("n").alias("top_n"), kind.alias("kind"))
