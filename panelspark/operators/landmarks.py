"""Landmark comparisons over several seeds: time counted from an event that the units compared have to live to.

A treated unit's landmark is its own event. Others are given one: a lag drawn from those of the treated of their own cell.
Lags are days, so a cell's lags are a step function of at most as many steps as days, and a draw is a place on it: no pool
of rows is ever numbered or gathered. Steps are met by an equi join on parts of the function, so a draw costs no walk over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators import stats as S

#: Parts of a cell's step function that places are dealt over; any number gives the same draws.
PARTS = 256


def hashed_draw(unit: Column, seed: Column) -> Column:
    return F.xxhash64(unit, seed)


def landmarks(units: DataFrame, cell: list[str], seeds: tuple[int, ...], draw: Callable[[Column, Column], Column] = hashed_draw) -> DataFrame:
    """units (id, treated, start, event, done, left, cell columns) with seed, landmark and alive: a row a unit and seed.

    alive: begun by the landmark, and neither done nor left by it. Treated units without an event at or after their start,
    and others of a cell without a treated lag, have no landmark and are not alive.
    """
    lag = F.when(F.col("treated") & (F.col("event") >= F.col("start")), F.datediff("event", "start"))
    steps = units.select(*cell, lag.alias("__lag")).where("__lag is not null").groupBy(*cell, "__lag").agg(F.count("*").alias("__k"))
    own = W.partitionBy(*cell)
    ladder = steps.withColumn("__high", F.sum("__k").over(own.orderBy("__lag"))).withColumn("__size", F.sum("__k").over(own)).withColumn("__low", F.col("__high") - F.col("__k"))
    part = lambda place: F.expr(f"({place}) * {PARTS} div __size")
    parts = ladder.withColumn("__part", F.explode(F.sequence(part("__low"), part("__high - 1")))).select(*cell, "__part", "__low", "__high", "__lag")
    sizes = ladder.groupBy(*cell).agg(F.max("__size").alias("__size"))
    # Both grow with cells and days alone.
    met = units.join(F.broadcast(sizes), cell, "left").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    met = met.withColumn("__place", F.when(F.col("treated"), None).otherwise(F.pmod(draw(F.col("id"), F.col("seed")), F.col("__size")))).withColumn("__part", part("__place"))
    at_step = [F.col(f"m.{c}") == F.col(f"p.{c}") for c in (*cell, "__part")] + [F.col("m.__place") >= F.col("p.__low"), F.col("m.__place") < F.col("p.__high")]
    drawn = met.alias("m").join(F.broadcast(parts.alias("p")), at_step, "left").select("m.*", F.col("p.__lag").alias("__lag"))
    at = F.when(F.col("treated"), F.when(F.col("event") >= F.col("start"), F.col("event"))).otherwise(F.date_add("start", F.col("__lag").cast("int")))
    placed = drawn.withColumn("landmark", at).drop("__place", "__part", "__size", "__lag")
    by = lambda c: F.coalesce(F.col(c) <= F.col("landmark"), F.lit(False))
    return placed.withColumn("alive", F.col("landmark").isNotNull() & by("start") & ~by("done") & ~by("left"))


def compared(placed: DataFrame, cell: list[str]) -> DataFrame:
    """A row a seed: units of both groups alive, those on common cells, days from landmark to done of both (others reweighted to the treated's cells), shares done and left, and standardised differences."""
    alive = placed.where("alive").withColumn("days", F.datediff("done", "landmark").cast("double")).withColumn("finished", F.col("done").isNotNull().cast("double")).withColumn("gone", F.col("left").isNotNull().cast("double"))
    # Units alike in all that is compared are a row with their number: as many as cells and days.
    alike = alive.groupBy("seed", *cell, "treated", "days", "finished", "gone").agg(F.count("*").alias("__n"))
    t, others, units = F.col("treated"), ~F.col("treated"), lambda side: F.sum(F.when(side, F.col("__n")).otherwise(0))
    counts = alike.groupBy("seed").agg(units(t).alias("n_treated"), units(others).alias("n_others"))
    both = S.reweight(alike, "treated", ["seed", *cell], "__n")
    parts, weight = [units(t).alias("n_support")], F.col("weight") * F.col("__n")
    for c in ("days", "finished", "gone"):
        m1, v1 = S.weighted(F.when(t, F.col(c)), F.when(t, weight))
        m0, v0 = S.weighted(F.when(others, F.col(c)), F.when(others, weight))
        parts += [m1.alias(f"{c}_treated"), m0.alias(f"{c}_others"), ((m1 - m0) / F.nullif(F.sqrt((v1 + v0) / 2), F.lit(0.0))).alias(f"{c}_difference")]
    return counts.join(both.groupBy("seed").agg(*parts), "seed", "left")
