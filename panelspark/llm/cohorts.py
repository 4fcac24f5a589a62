"""Cohort retention as known at two times: activity bit vectors a client, merged over salts, set bits exploded into cells.

A client's activity in a state of knowledge is a row for each 64 periods: a bitmask of the periods it was seen in, and a
sparse vector (period, cents) of those whose cents are not 0. Clients with many rows are dealt over salts; each salt makes
a partial vector, and partial vectors of a client meet FAN_IN at a time, so no list grows with a client's rows.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize

DAY = 86_400_000_000
BITS = 64
#: Rows of a client in one salt; a client is salted if it has four times as many and at least one of HOT_PART of all rows.
SALT_ROWS, HOT_PART = 2_000, 10_000
#: Partial vectors that meet in one row at a time.
FAN_IN = 64
#: Cents of a larger size, like those of values that are not finite, count as 0: no sum of them can be held.
MOST_CENTS = 2**53


def micros(at: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone as it is written, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    since = at - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda unit, size: (F.extract(F.lit(unit), since) * F.lit(size)).cast("long")
    whole = lambda unit, size: F.extract(F.lit(unit), since).cast("long") * F.lit(size)
    return whole("DAY", DAY) + whole("HOUR", 3_600_000_000) + whole("MINUTE", 60_000_000) + part("SECOND", 1_000_000)


def retention(
    clicks: DataFrame, clients: DataFrame, known_before: str = "2024-02-15 00:00:00", start_kind: str = "signup",
    cohort_days: int = 1, period_days: int = 1, late_every: int = 3, late_days: int = 100, salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """One row per nonempty cell (state, segment, cohort, period): users, users_crc32, moved, cents.

    State 0 knows the clicks that arrive before known_before, state 1 all. A click whose id has a crc32 that late_every
    divides arrives crc32 mod late_days days after arrived_at. Clicks alike in all columns of the contract count once, columns
    beside them are ignored; null ts or client_id drop a click; a click of null click_id is on time; one of null arrived_at is
    known in state 1 only. Of several clients rows of a client_id the smallest segment counts; null, missing: ''. Null values,
    and those without finite cents, are 0 cents. Clients without a start, and empty tables, give no rows.
    """
    kinds = dict(clicks.dtypes)
    late = F.crc32(F.col("click_id").cast("string"))
    arrives = micros(F.col("arrived_at"), kinds["arrived_at"]) + F.when(late % late_every == 0, late % late_days).otherwise(0) * F.lit(DAY)
    before = int(datetime.fromisoformat(known_before).replace(tzinfo=UTC).timestamp()) * 1_000_000
    seen = clicks.where("ts is not null and client_id is not null")
    early = F.coalesce(arrives < before, F.lit(False)).alias("early")
    at = micros(F.col("ts"), kinds["ts"]).alias("at")

    known = _starts(seen.select("client_id", "kind", at, early), clients, start_kind)
    total = known.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_PART clients, as each has more than that part of all rows.
    hot = known.where(F.col("n") > max(4 * salt_rows, total // HOT_PART)).select("client_id", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    hot = materialize(hot, "cohorts-hot")
    salts = F.coalesce("salts", F.lit(1))

    columns = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]
    once = seen.select(*columns).distinct()
    exact = F.floor(F.lit(100) * F.col("value") + F.lit(0.5))
    cents = F.when(F.abs(F.col("value")) < MOST_CENTS / 100, exact).otherwise(0).alias("cents")
    rows = once.select("client_id", at, early, cents, F.xxhash64("click_id", "ts", "value").alias("mark"))
    rows = rows.join(F.broadcast(hot), "client_id", "left").select("client_id", F.pmod("mark", salts).cast("int").alias("salt"), "at", "early", "cents")
    dealt = known.join(F.broadcast(hot), "client_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("client_id", "salt", "start0", "start1")

    whole = _merged(_partial(rows.join(dealt, ["client_id", "salt"]), period_days * DAY), hot)
    moved = (_days(F.col("start0"), cohort_days) != _days(F.col("start1"), cohort_days)).alias("moved")
    about = known.select("client_id", "segment", "start0", "start1", moved)
    start = F.when(F.col("state") == 0, F.col("start0")).otherwise(F.col("start1"))
    bits = F.expr(f"transform(filter(sequence(0, {BITS - 1}), i -> getbit(mask, i) = 1), i -> struct(word * {BITS} + i as period, 1L as one, 0L as cents))")
    sums = F.expr("transform(vector, v -> struct(v.period as period, 0L as one, v.cents as cents))")
    cells = whole.join(about, "client_id").select(
        "state", "segment", _days(start, cohort_days).alias("cohort"),
        F.crc32(F.col("client_id").cast("string")).alias("crc"), F.coalesce("moved", F.lit(False)).cast("long").alias("moved"), F.explode(F.concat(bits, sums)).alias("x"),
    )
    return cells.groupBy("state", "segment", "cohort", F.col("x.period").alias("period")).agg(
        F.sum("x.one").alias("users"),
        F.sum(F.col("x.one") * F.col("crc")).alias("users_crc32"),
        F.sum(F.col("x.one") * F.col("moved")).alias("moved"),
        F.sum("x.cents").alias("cents"),
    )


def _days(at: Column, days: int) -> Column:
    """Whole stretches of so many days since 1970, in whole numbers: a double would round microseconds of far years."""
    size = F.lit(days * DAY)
    return F.call_function("div", at - F.pmod(at, size), size)


def _starts(seen: DataFrame, clients: DataFrame, start_kind: str) -> DataFrame:
    """client_id, start0, start1, n, segment of every client that has a start: one aggregation whose partial rows a task sends once a client."""
    begun = F.when(F.col("kind") == start_kind, F.col("at"))
    first = seen.groupBy("client_id").agg(F.min(F.when(F.col("early"), begun)).alias("start0"), F.min(begun).alias("start1"), F.count("*").alias("n"))
    named = clients.where("client_id is not null").groupBy("client_id").agg(F.min("segment").alias("segment"))
    return materialize(first.where("start1 is not null").join(named, "client_id", "left").na.fill("", ["segment"]), "cohorts-starts")


def _partial(rows: DataFrame, period: int) -> DataFrame:
    """A bitmask and a sparse vector for every client, salt, state and 64 periods; at most 64 entries a vector."""
    state = lambda n, start, known: F.struct(F.lit(n).alias("state"), F.col(start).alias("start"), known.alias("known"))
    states = F.explode(F.array(state(0, "start0", F.col("early")), state(1, "start1", F.lit(True))))
    each = rows.select("client_id", "salt", "at", "cents", states.alias("s")).where("s.known and at >= s.start")
    place = F.expr(f"(at - s.start) div {period}L").alias("period")
    sums = each.groupBy("client_id", "salt", F.col("s.state").alias("state"), place).agg(F.sum("cents").alias("cents"))
    return sums.groupBy("client_id", "salt", "state", F.expr(f"period div {BITS}").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(period % {BITS} as int))")).alias("mask"),
        F.collect_list(F.when(F.col("cents") != 0, F.struct("period", "cents"))).alias("vector"),
    )


def _merged(partial: DataFrame, hot: DataFrame) -> DataFrame:
    """The partial vectors of a client, state and word as one: masks by OR, vectors by sums, FAN_IN salts at a time."""
    salts = hot.agg(F.max("salts")).first()[0] or 1
    added = F.expr("""transform(array_distinct(transform(flatten(vectors), v -> v.period)),
        p -> struct(p as period, aggregate(filter(flatten(vectors), v -> v.period = p), 0L, (s, v) -> s + v.cents) as cents))""")
    while salts > 1:
        salts = -(-salts // FAN_IN)
        met = partial.groupBy("client_id", "state", "word", F.expr(f"salt div {FAN_IN}").cast("int").alias("salt"))
        partial = met.agg(F.bit_or("mask").alias("mask"), F.collect_list("vector").alias("vectors"))
        partial = partial.select("client_id", "state", "word", "salt", "mask", F.when(F.size("vectors") == 1, F.col("vectors")[0]).otherwise(added).alias("vector"))
    return partial
