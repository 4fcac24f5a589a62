"""Spells, Kaplan–Meier, hazards and cumulative incidence, all as windows over distinct times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spell(start: Column, end: Column, censor: Column) -> tuple[Column, Column]:
    """(days, event): to the end if there is one, else to the censoring date."""
    return F.datediff(F.coalesce(end, censor), start), end.isNotNull()


def _at_risk(df: DataFrame, key: list[str], t: str, events: dict[str, Column]) -> DataFrame:
    times = df.where(F.col(t) >= 0).groupBy(*key, t).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in events.items()])
    later = W.partitionBy(*key).orderBy(F.desc(t))
    return times.withColumn("at_risk", F.sum("n").over(later.rowsBetween(W.unboundedPreceding, W.currentRow)))


def kaplan_meier(df: DataFrame, key: list[str], t: str, event: Column) -> DataFrame:
    """(key, t, n, events, at_risk, survival) at every distinct time >= 0."""
    risk = _at_risk(df, key, t, {"events": event})
    so_far = W.partitionBy(*key).orderBy(t).rowsBetween(W.unboundedPreceding, W.currentRow)
    return risk.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(so_far))


def km_quantiles(curve: DataFrame, key: list[str], t: str, quantiles: dict[str, float]) -> DataFrame:
    """(key, quantiles...): the first time at which survival is at most 1 - q; null if it never is."""
    return curve.groupBy(*key).agg(*[F.min(F.when(F.col("survival") <= 1 - q, F.col(t))).alias(name) for name, q in quantiles.items()])


def hazard(df: DataFrame, key: list[str], t: str, event: Column, width: int, upto: int, least: int) -> DataFrame:
    """(key, bin, at_risk, events, hazard) of bins of `width` days below `upto`; cells of fewer than `least` at risk are left out."""
    bins = df.where(F.col(t) >= 0).withColumn("bin", F.floor(F.least(F.col(t), F.lit(upto)) / width).cast("int")).groupBy(*key, "bin").agg(F.count("*").alias("n"), F.count_if(event & (F.col(t) < upto)).alias("events"))
    dense = bins.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(upto // width)))).join(bins, [*key, "bin"], "left").na.fill(0, ["n", "events"])
    later = W.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dense.withColumn("at_risk", F.sum("n").over(later)).where((F.col("bin") < upto // width) & (F.col("at_risk") >= least))
    return out.select(*key, "bin", "at_risk", "events", (F.col("events") / F.col("at_risk")).alias("hazard"))


def incidence(df: DataFrame, key: list[str], t: str, cause: Column, other: Column) -> DataFrame:
    """(key, t, at_risk, cif): Aalen–Johansen incidence of the cause where the other exit competes."""
    risk = _at_risk(df, key, t, {"of": cause, "out": other})
    order = W.partitionBy(*key).orderBy(t)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    stay = risk.withColumn("__s", F.product(1 - (F.col("of") + F.col("out")) / F.col("at_risk")).over(so_far))
    step = F.coalesce(F.lag("__s").over(order), F.lit(1.0)) * F.col("of") / F.col("at_risk")
    return stay.withColumn("__step", step).withColumn("cif", F.sum("__step").over(so_far)).select(*key, t, "at_risk", "cif")
