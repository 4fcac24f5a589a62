"""What the columns of a table hold, how far one table is found in another, and what a denominator leaves out.

Every report is one aggregation whose partial rows are few: no step gathers a column's values or a unit's rows in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What a flag may say, and the words by which a column of numbers is known to be a code.
FLAGS = ("Y", "N", "y", "n", "true", "false", "P", "R", "E")
CODE_NAMES = r"(?i)number|block|lot|id$|type$|district|zip|code"
NO_PERIOD = "none"


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False))


def populated_by(df: DataFrame, columns: list[str], period: Column) -> DataFrame:
    """(column, period, n, n_filled, share): how many rows of each period have a value that is not blank; rows without a period are of period "none".

    One aggregation by period counts all columns at once.
    """
    counted = df.groupBy(F.coalesce(period.cast("string"), F.lit(NO_PERIOD)).alias("period")).agg(F.count("*").alias("n"), *[F.count_if(_filled(c)).alias(f"__{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("n_filled")) for i, c in enumerate(columns)])
    return counted.select(F.explode(each).alias("e"), "period", "n").select("e.column", "period", "n", "e.n_filled", (F.col("e.n_filled") / F.col("n")).alias("share"))


def _kind(values: DataFrame) -> DataFrame:
    """(column, kind) of (column, value, n): the kind that nearly all filled rows agree with."""
    share = lambda rx: F.sum(F.when(F.col("value").rlike(rx), F.col("n")).otherwise(0)) / F.sum("n")
    shares = values.groupBy("column").agg(
        share(r"^POINT \(").alias("point"), share(r"^\d{4}-\d\d-\d\d[T ]").alias("date"), share(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$").alias("number"),
        F.count("*").alias("n_distinct"), F.bool_and(F.col("value").isin(*FLAGS)).alias("flags"),
    )
    kind = (
        F.when(F.col("column").startswith(":"), "system").when(F.col("point") > 0.9, "geometry").when(F.col("date") > 0.95, "date")
        .when((F.col("n_distinct") <= 3) & F.col("flags"), "flag")
        .when(F.col("number") > 0.95, F.when(F.col("column").rlike(CODE_NAMES), "code").otherwise("number")).otherwise("text")
    )
    return shares.select("column", "n_distinct", kind.alias("kind"))


def profile(df: DataFrame, columns: list[str], period: Column, top: int = 3, width: int = 28, spread: float = 0.5) -> DataFrame:
    """(column, kind, n, n_filled, populated, n_distinct, examples, note), a row a column, also of an empty table.

    examples are the most frequent values, ties to the smaller, each cut to `width` characters; dates count by day. The
    note names the periods that fill a column least and most, where they differ by more than `spread`, a flag of a single
    value, or a column that hardly any row fills. A column without values is text.
    """
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where(F.trim("value") != "")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    kinds = _kind(values)
    shown = values.join(F.broadcast(kinds), "column").withColumn("value", F.when(F.col("kind") == "date", F.substring("value", 1, 10)).otherwise(F.col("value")))
    ranked = shown.groupBy("column", "value").agg(F.sum("n").alias("n")).withColumn("__r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= top)
    examples = ranked.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("__r", F.substring("value", 1, width).alias("v"), F.col("value")))).alias("t"))
    eras = populated_by(df, columns, period)
    ends = F.struct("share", "period")
    dated = F.col("period") != NO_PERIOD
    by = eras.groupBy("column").agg(F.sum("n").alias("n"), F.sum("n_filled").alias("n_filled"), F.min(F.when(dated, ends)).alias("low"), F.max(F.when(dated, F.struct("share", "period"))).alias("high"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = every.join(by, "column", "left").join(kinds, "column", "left").join(examples, "column", "left")
    percent = lambda x: F.format_string("%.1f%%", F.round(100 * x, 1))
    populated = F.col("n_filled") / F.col("n")
    note = (
        F.when((F.col("kind") == "flag") & (F.col("n_distinct") == 1), F.concat(F.lit("one value: "), F.col("t")[0]["value"]))
        .when(populated < 0.01, F.lit("hardly filled"))
        .when(F.col("high.share") - F.col("low.share") > spread, F.concat(percent(F.col("low.share")), F.lit(" in "), F.col("low.period"), F.lit(", "), percent(F.col("high.share")), F.lit(" in "), F.col("high.period")))
        .otherwise("")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("column", F.coalesce("kind", F.lit("text")).alias("kind"), zero("n"), zero("n_filled"), populated.alias("populated"), zero("n_distinct"), F.concat_ws("; ", F.transform("t", lambda x: x["v"])).alias("examples"), note.alias("note"))


def set_coverage(elements: DataFrame, key: str, element: str, layer: DataFrame, tests: dict[str, tuple[str, Column]], block: int = 4, block_key: str = "block") -> DataFrame:
    """(key, has_key, one flag a test, block_only): whether any element of an item's set stands in a layer's column, under a condition of the layer's row.

    elements has a row for each element of an item, repeats allowed; an item of null elements alone has no key. tests:
    name -> (layer column, condition); the first is the plain hit. block_only holds for an item without a hit one of whose
    elements begins with a block of the layer (`block_key`, of `block` characters). The layer becomes one row a token that
    says which tests it passes; a set is never gathered, its tokens meet the layer once, however many tests there are, and
    their bits are merged before they leave a task. Null tokens match nothing.
    """
    names = list(tests)
    token = lambda kind, value, bit, when: F.when(when & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("token"), F.lit(1 << bit).alias("bits")))
    said = [token("e", F.col(column), i, F.coalesce(condition, F.lit(False))) for i, (column, condition) in enumerate(tests.values())]
    said.append(token("b", F.col(block_key), len(names), F.lit(True)))
    known = layer.select(F.explode(F.array_compact(F.array(*said))).alias("t")).select("t.*").groupBy("kind", "token").agg(F.bit_or("bits").alias("bits"))
    e = F.col(element).cast("string")
    looked_for = F.array(F.struct(F.lit("e").alias("kind"), e.alias("token")), F.struct(F.lit("b").alias("kind"), F.substring(e, 1, block).alias("token")))
    asked = elements.select(F.col(key), F.explode(looked_for).alias("a")).select(key, "a.*").distinct()
    bits = asked.join(known, ["kind", "token"], "left").groupBy(key).agg(F.bool_or(F.col("token").isNotNull()).alias("has_key"), F.coalesce(F.bit_or("bits"), F.lit(0)).alias("__bits"))
    on = lambda i: F.col("__bits").bitwiseAND(1 << i) != 0
    return bits.select(key, "has_key", *[on(i).alias(n) for i, n in enumerate(names)], (~on(0) & on(len(names))).alias("block_only"))


def risk_steps(panel: DataFrame, unit: str, period: str, steps: list[tuple[str, Column]], events: DataFrame) -> DataFrame:
    """(step, rule, units, unit_periods, events, events_lost, rate): what each restriction of a panel keeps, and the events that it loses; rate is of 10,000 unit-periods.

    A row counts for a step if it fulfils it and all before it; null is not fulfilled. events (unit, period) count once
    where the panel has their unit-period. Rows are told by how many steps they pass, units by how many any row of theirs
    passes, so a busy unit costs one partial row a task. panel has one row a unit and period.
    """
    k = len(steps)
    depth, kept = F.lit(0), F.lit(True)
    for _, condition in steps:
        kept = kept & F.coalesce(condition, F.lit(False))
        depth = depth + kept.cast("int")
    happened = events.select(unit, period).where(F.col(unit).isNotNull() & F.col(period).isNotNull()).distinct().withColumn("__e", F.lit(1))
    rows = panel.select(unit, period, depth.alias("__d")).join(happened, [unit, period], "left")
    at = lambda i: F.col("__d") > i
    per_unit = rows.groupBy(unit).agg(F.max("__d").alias("__d"), *[F.count_if(at(i)).alias(f"r{i}") for i in range(k)], *[F.count_if(at(i) & F.col("__e").isNotNull()).alias(f"e{i}") for i in range(k)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = per_unit.agg(*[x for i in range(k) for x in (F.count_if(at(i)).alias(f"u{i}"), total(f"r{i}").alias(f"r{i}"), total(f"e{i}").alias(f"e{i}"))])
    listed = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"u{i}").alias("units"), F.col(f"r{i}").alias("unit_periods"), F.col(f"e{i}").alias("events"), (F.col(f"e{i - 1}") - F.col(f"e{i}") if i else F.lit(0).cast("long")).alias("events_lost")) for i, (n, _) in enumerate(steps)])
    return one.select(F.explode(listed).alias("s")).select("s.*", (10000 * F.col("s.events") / F.nullif("s.unit_periods", F.lit(0))).alias("rate"))


def items_kept(items: DataFrame, key: str, kind: str, unit: str, period: str, panel: DataFrame, condition: Column) -> DataFrame:
    """(kind, in_panel, kept): items any of whose unit-periods the panel has, and those any of whose unit-periods fulfils the condition too; a null kind is "(blank)".

    items has a row for each unit of an item; an item has one kind and period."""
    states = panel.groupBy(unit, period).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias("__k"))
    met = items.join(states, [unit, period]).groupBy(key, F.coalesce(kind, F.lit("(blank)")).alias(kind)).agg(F.bool_or("__k").alias("__k"))
    return met.groupBy(kind).agg(F.count("*").alias("in_panel"), F.count_if("__k").alias("kept"))


def case_tests(cases: DataFrame, printed: str, key: str, stem: str, records: DataFrame, record_id: str, record_key: str, record_stem: str) -> DataFrame:
    """cases with j_raw, j_key, j_stem, j_any: whether a number stands among the records as printed, normalised, or without its suffix.

    Blank and null values match nothing. Each test meets the distinct values of the records, so a number with many records costs one row.
    """
    tests = [("j_raw", printed, record_id), ("j_key", key, record_key), ("j_stem", stem, record_stem)]
    out = cases
    for name, left, right in tests:
        known = records.select(F.col(right).cast("string").alias(f"__{name}")).where(F.col(f"__{name}") != "").distinct().withColumn(name, F.lit(True))
        out = out.join(known, F.nullif(F.col(left).cast("string"), F.lit("")) == F.col(f"__{name}"), "left").drop(f"__{name}").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("j_any", reduce(lambda a, b: a | b, [F.col(n) for n, _, _ in tests]))


def other_century(cases: DataFrame, key: str, serial: Column, short_year: Column, records: DataFrame, record_key: str) -> DataFrame:
    """cases with `centuries`: in how many of 1900 and 2000 plus its short year a record of that serial stands. More than one: to expand the year is a guess. Without a short year 0."""
    forms = F.array(*[F.concat((F.lit(c) + short_year.cast("int")).cast("string"), serial) for c in (1900, 2000)])
    known = records.select(F.col(record_key).alias("__form")).where("__form <> ''").distinct()
    asked = cases.select(key, F.explode(forms).alias("__form")).where("__form is not null").distinct()
    hits = asked.join(known, "__form").groupBy(key).agg(F.count("*").alias("centuries"))
    return cases.join(hits, key, "left").withColumn("centuries", F.coalesce("centuries", F.lit(0)))
