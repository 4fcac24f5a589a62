"""Resolvers: tiers of keys with uniqueness, in-force values, vintages, variants, best scores with a margin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators.joins import cascade_join


def first_of(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, value): the value of each key's first row; null keys have none."""
    named = reduce(lambda d, k: d.where(F.col(k).isNotNull()), key, df)
    return named.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def only_of(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) of keys that stand in one row only."""
    named = reduce(lambda d, k: d.where(F.col(k).isNotNull()), key, df)
    return named.groupBy(*key).agg(F.count("*").alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def of_roll(df: DataFrame, roll: DataFrame, stem: str, ordinal: str, date: str, token: str, order: list[str], value: str, how: str = "how") -> DataFrame:
    """df with `value` of the roll's row that it belongs to, and the tier that told it.

    The first row of its stem and ordinal, else the first of its stem and date, else the only row of its date, else the only
    one of its date whose token is its own, else none. The four columns have the same names on both sides; nulls match
    nothing. Rows of a date are counted, not paired: each tier is a lookup of one row a key. A value that is null in the
    roll tells nothing, so a later tier may.
    """
    tiers = [
        ("ordinal", first_of(roll, [stem, ordinal], order, value), [stem, ordinal]),
        ("date", first_of(roll, [stem, date], order, value), [stem, date]),
        ("only", only_of(roll, [date], value), [date]),
        ("token", only_of(roll, [date, token], value), [date, token]),
    ]
    return cascade_join(df, tiers, value, how)


def fallback(df: DataFrame, exact: DataFrame, on: list[str], general: DataFrame, on_general: list[str], value: str) -> DataFrame:
    """df with `value` of the exact key, else of the general one; both lookups have one row a key."""
    out = df.join(exact.withColumnRenamed(value, "__exact"), on, "left").join(general.withColumnRenamed(value, "__general"), on_general, "left")
    return out.withColumn(value, F.coalesce("__exact", "__general")).drop("__exact", "__general")


def vintage(year: Column, tables: list[int], current: int) -> tuple[Column, Column]:
    """(table year, is_snapshot): the year's own table, the current one for later years, null for years without any."""
    own = year.isin(tables)
    return F.when(own, year).when(year > max(tables), F.lit(current)), F.coalesce(~own & (year > max(tables)), F.lit(False))


def variants(df: DataFrame, name: str, forms: list[Column]) -> DataFrame:
    """A row for each form of a name that is not null, with `variant` and its `place`, the earliest of equal forms."""
    listed = F.array(*[F.struct(f.alias("variant"), F.lit(i).alias("place")) for i, f in enumerate(forms)])
    out = df.withColumn("__f", F.explode(listed)).select(*df.columns, "__f.variant", "__f.place").where("variant is not null")
    return out.groupBy(*df.columns, "variant").agg(F.min("place").alias("place"))


def best_with_margin(scored: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """(key, candidate, score, runner_up, margin): the best candidate, ties to the smaller, and how far it is ahead of the second."""
    ranked = scored.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), candidate))).where("__r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("__r") == r, F.col(c)))
    out = ranked.groupBy(key).agg(pick(1, candidate).alias(candidate), pick(1, score).alias(score), pick(2, score).alias("runner_up"))
    return out.withColumn("margin", F.col(score) - F.coalesce("runner_up", F.lit(0)))


def candidates_of(blocks: Column, lots: Column) -> Column:
    """Every block with every lot of two lists, as structs."""
    return F.flatten(F.transform(blocks, lambda b: F.transform(lots, lambda l: F.struct(b.alias("block"), l.alias("lot")))))


def any_within(value: Column, others: list[Column], tolerance: float) -> Column:
    """Whether one of the other values, nulls aside, is within the tolerance."""
    return F.exists(F.array_compact(F.array(*others)), lambda o: F.abs(o - value) <= tolerance)


def vintage_panel(live: DataFrame, keyed: DataFrame, spatial: DataFrame, current: DataFrame, first: int, last: int) -> DataFrame:
    """(id, year, value, vintage, is_snapshot, method) for every year from first to last that a unit (id, y0, y1) lives in; open ends are null.

    A year takes its values from one source: the table of that year (keyed: id, year, value) if there is one, else the
    layer of that year (spatial: id, year, value), else, after the last layer, the current layer (current: id, value)
    carried forward as a snapshot. Years that none serves are left out; a unit that its year's source lacks has null. Of
    several values of a unit and year the smallest counts.
    """
    # A row a year, of which there are last - first + 1.
    years = live.sparkSession.createDataFrame([(y,) for y in range(first, last + 1)], "year int")
    table_years = keyed.select(F.col("year").cast("int")).distinct().withColumn("__table", F.lit(True))
    layer_years = spatial.select(F.col("year").cast("int")).distinct().withColumn("__layer", F.lit(True))
    newest = layer_years.agg(F.max("year").alias("__newest"))
    source = F.when(F.col("__table"), "table").when(F.col("__layer"), "spatial").when(F.col("year") > F.coalesce("__newest", F.lit(0)), "carried")
    served = years.join(table_years, "year", "left").join(layer_years, "year", "left").crossJoin(F.broadcast(newest)).withColumn("__source", source).where("__source is not null").select("year", "__source")
    begins, ends = F.greatest(F.coalesce("y0", F.lit(first)), F.lit(first)).cast("int"), F.least(F.coalesce("y1", F.lit(last)), F.lit(last)).cast("int")
    lived = live.where(begins <= ends).select("id", F.explode(F.sequence(begins, ends)).alias("year"))
    rows = lived.join(F.broadcast(served), "year")
    of = lambda df, name: df.groupBy("id", F.col("year").cast("int").alias("year")).agg(F.min("value").alias("value")).withColumn("__source", F.lit(name))
    values = of(keyed, "table").unionByName(of(spatial, "spatial"))
    now = current.groupBy("id").agg(F.min("value").alias("__now"))
    met = rows.join(values, ["id", "year", "__source"], "left").join(now, "id", "left")
    carried = F.col("__source") == "carried"
    return met.select(
        "id", "year", F.when(carried, F.col("__now")).otherwise(F.col("value")).alias("value"),
        F.when(carried, F.lit("current layer, carried forward")).otherwise(F.concat(F.when(F.col("__source") == "table", F.lit("table ")).otherwise(F.lit("layer ")), F.col("year").cast("string"))).alias("vintage"),
        carried.alias("is_snapshot"), F.when(F.col("__source") == "table", F.lit("table")).otherwise(F.lit("spatial")).alias("method"),
    )
