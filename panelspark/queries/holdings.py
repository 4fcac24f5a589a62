"""What tables hold and how far they meet: profiles, set coverage, risk sets, rolls, labels of lists, universes, records by three keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import coverage as V
from panelspark.operators import joins as J
from panelspark.operators import resolvers as R
from panelspark.operators import rules as U
from panelspark.session import table

CLIENT_COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
LABELS = [
    (r"^(large|huge)\b", "big", ""),
    (r"\b(widget|ring)$", "fitting", "size may be nominal"),
    (r"^B\d$", "old brand", "brand of one digit"),
    (r"^(home|office|garden)$", "indoors", ""),
    (r"^(small|red)\b", "small", ""),
]


def client_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of clients: kind, share of filled rows, distinct and most frequent values, and a note where months differ."""
    return V.profile(table(spark, d, "clients"), CLIENT_COLUMNS, F.date_format("updated_at", "yyyy-MM"))


def client_filled(spark: SparkSession, d: str) -> DataFrame:
    """Share of clients that fill each column, by month of the update."""
    return V.populated_by(table(spark, d, "clients"), CLIENT_COLUMNS, F.date_format("updated_at", "yyyy-MM"))


def sale_set_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sales of spring by what winter's sales knew of their vendor's items: the pair itself, its size's lot, one still sold in May, or the vendor alone; by status."""
    lines = table(spark, d, "sale_lines")
    pair = F.concat(F.lpad(F.col("vendor_id").cast("string"), 4, "0"), F.lpad(F.col("item_id").cast("string"), 6, "0"))
    sizes = table(spark, d, "items").groupBy("item_id").agg(F.min("size").alias("size"))
    late = lines.where("shipped_at >= timestamp'2024-05-01'").select(pair.alias("lot")).distinct().withColumn("active", F.lit(True))
    winter = lines.where("shipped_at < timestamp'2024-02-15'").select("vendor_id", "item_id", pair.alias("lot")).distinct()
    layer = winter.join(sizes, "item_id", "left").join(late, "lot", "left").select(
        "lot", F.concat(F.lpad(F.col("vendor_id").cast("string"), 4, "0"), F.lpad(F.col("size").cast("string"), 6, "0")).alias("mapped"), F.lpad(F.col("vendor_id").cast("string"), 4, "0").alias("block"), "active"
    )
    spring = lines.where("shipped_at >= timestamp'2024-03-01'").select("sale_id", pair.alias("lot"))
    flags = V.set_coverage(spring, "sale_id", "lot", layer, {"hit": ("lot", F.lit(True)), "mapped": ("mapped", F.lit(True)), "active": ("lot", F.col("active"))})
    status = table(spark, d, "sales").groupBy("sale_id").agg(F.min("status").alias("status"))
    told = flags.join(status, "sale_id", "left").where("sale_id is not null")
    count = lambda c: F.count_if(c)
    return told.groupBy("status").agg(
        F.count("*").alias("items"), count("has_key").alias("with_key"), count("hit").alias("joined"), count("mapped").alias("joined_map"), count("active").alias("joined_active"),
        count(F.col("hit") & ~F.col("active")).alias("retired_only"), count("block_only").alias("block_only"), count(F.col("has_key") & ~F.col("hit") & ~F.col("block_only")).alias("no_block"),
    )


def _client_months(spark: SparkSession, d: str) -> DataFrame:
    """(client_id, month, segment, city): every month from a client's first change to the last of all clients, with the class in force: the first told in that month, else the earliest told of all."""
    c = table(spark, d, "client_changes").where("client_id is not null and valid_at is not null").withColumn("month", F.trunc("valid_at", "MM")).withColumn("segment", F.coalesce("segment", F.lit("")))
    end = c.agg(F.max("month").alias("__end"))
    panel = c.groupBy("client_id").agg(F.min("month").alias("__first")).crossJoin(F.broadcast(end)).select("client_id", F.explode(F.sequence("__first", "__end", F.expr("interval 1 month"))).alias("month"))
    order = ["valid_at", "change_id"]
    told = R.fallback(panel, R.first_of(c, ["client_id", "month"], order, "segment"), ["client_id", "month"], R.first_of(c, ["client_id"], order, "segment"), ["client_id"], "segment")
    cities = R.first_of(c.where("city is not null"), ["client_id"], order, "city")
    return told.join(cities, "client_id", "left")


def _sold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sales").select("sale_id", "client_id", F.trunc("sold_at", "MM").alias("month"), F.col("priority").cast("string").alias("priority"))


def client_risk_steps(spark: SparkSession, d: str) -> DataFrame:
    """From every month of every client down to private ones of a known segment and city: clients, months, months with a sale, what each step loses, and the rate of 10,000."""
    steps = [("every month", F.lit(True)), ("not public that month", F.col("segment") != "public"), ("a segment in force", F.col("segment") != ""), ("a city known", F.col("city").isNotNull())]
    return V.risk_steps(_client_months(spark, d), "client_id", "month", steps, _sold(spark, d))


def client_risk_items(spark: SparkSession, d: str) -> DataFrame:
    """Sales in a month that the panel has, and in one that all steps keep, by priority."""
    held = (F.col("segment") != "public") & (F.col("segment") != "") & F.col("city").isNotNull()
    return V.items_kept(_sold(spark, d).where("sale_id is not null"), "sale_id", "priority", "client_id", "month", _client_months(spark, d), held)


def sale_rolls(spark: SparkSession, d: str) -> DataFrame:
    """Sales that a change of a client belongs to: by client and number, client and hour, the only change of its hour, the only one of its hour and city. How many each tier tells, and a checksum."""
    hour = lambda c: F.date_trunc("hour", c)
    roll = table(spark, d, "client_changes").select("client_id", F.col("seq").alias("number"), hour("valid_at").alias("hour"), "city", "change_id")
    cities = R.first_of(table(spark, d, "clients"), ["client_id"], ["updated_at", "city"], "city")
    sales = table(spark, d, "sales").select("sale_id", "client_id", (F.col("priority") * 7).cast("long").alias("number"), hour("sold_at").alias("hour")).join(cities, "client_id", "left")
    out = R.of_roll(sales, roll, "client_id", "number", "hour", "city", ["change_id"], "change_id")
    return out.groupBy("how").agg(F.count("*").alias("n"), F.sum("change_id").alias("changes"))


def item_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and notes of what an item's name, brand and kind say, each by the first rule that it matches."""
    said = table(spark, d, "items").select("item_id", F.concat_ws("; ", "name", "brand", "kind").alias("said"))
    out = J.rules_of_list(said, "said", LABELS)
    return out.select("item_id", F.concat_ws(",", "labels").alias("labels"), F.concat_ws(",", "notes").alias("notes"))


def sale_universe(spark: SparkSession, d: str) -> DataFrame:
    """Sales that any of five rules takes, with each rule's flag: held, urgent open, late, unpriced, or done and dear for their month."""
    s = table(spark, d, "sales").select("sale_id", "status", "priority", "total", F.date_format("sold_at", "yyyy-MM").alias("month"), (F.datediff("arrived_at", "sold_at") > 3).alias("late_by"))
    rules = {"held": F.col("status") == "held", "urgent": (F.col("priority") == 1) & (F.col("status") == "open"), "late": F.col("late_by"), "unpriced": F.col("total").isNull() | (F.col("total") <= 0)}
    out = U.universe(s, rules, "dear", F.col("status") == "done", "total", "month")
    return out.where("in_universe").select("sale_id", "month", *rules, "dear")


def client_record_tests(spark: SparkSession, d: str) -> DataFrame:
    """Clients of other sources among those of the web by address as printed, in small letters, and without a number before the at: how many each test joins, by source."""
    c = table(spark, d, "clients").select("client_id", "source", "email", F.lower(F.trim("email")).alias("address")).withColumn("stem", F.regexp_replace("address", r"\d+@.*$", ""))
    web, others = c.where("source = 'web'"), c.where("source <> 'web'")
    out = V.case_tests(others, "email", "address", "stem", web.select(F.col("email").alias("r_id"), F.col("address").alias("r_key"), F.col("stem").alias("r_stem")), "r_id", "r_key", "r_stem")
    return out.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(t).alias(t) for t in ("j_raw", "j_key", "j_stem", "j_any")])


QUERIES = {f.__name__: f for f in (client_profile, client_filled, sale_set_coverage, client_risk_steps, client_risk_items, sale_rolls, item_labels, sale_universe, client_record_tests)}

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(strftime(updated_at, '%Y-%m'), 'none') AS period, {c}::VARCHAR AS v FROM clients" for c in CLIENT_COLUMNS)
_MONTHS = """c AS (SELECT client_id, change_id, valid_at, date_trunc('month', valid_at)::DATE AS month, coalesce(segment, '') AS segment, city FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL),
        f AS (SELECT client_id, min(month) AS first, arg_min(segment, (valid_at, change_id)) AS segment0 FROM c GROUP BY 1),
        k AS (SELECT client_id, month, arg_min(segment, (valid_at, change_id)) AS segment1 FROM c GROUP BY ALL),
        ct AS (SELECT client_id, arg_min(city, (valid_at, change_id)) AS city FROM c WHERE city IS NOT NULL GROUP BY 1),
        m AS (SELECT client_id, unnest(generate_series(first::TIMESTAMP, (SELECT max(month) FROM c)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month, segment0 FROM f),
        p AS (SELECT m.client_id, m.month, coalesce(segment1, segment0) AS segment, city FROM m LEFT JOIN k USING (client_id, month) LEFT JOIN ct USING (client_id))"""
_PAIR = "lpad(vendor_id::VARCHAR, 4, '0') || lpad(item_id::VARCHAR, 6, '0')"
_FIRST_RULE = "CASE " + " ".join(f"WHEN regexp_matches(e, '{rx}') THEN {{'label': '{label}', 'note': '{note}'}}" for rx, label, note in LABELS) + " END"

ORACLE_SQL = {
    "client_profile": rf"""
        WITH l AS ({_LONG}), f AS (SELECT * FROM l WHERE trim(v) <> ''),
        g AS (SELECT "column", v, count(*) AS n FROM f GROUP BY ALL),
        s AS (SELECT "column", count(*) AS n_distinct, sum(n) FILTER (regexp_matches(v, '^\d{{4}}-\d\d-\d\d[T ]')) / sum(n) AS dates,
                     sum(n) FILTER (regexp_matches(v, '^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$')) / sum(n) AS numbers FROM g GROUP BY 1),
        k AS (SELECT "column", n_distinct, CASE WHEN dates > 0.95 THEN 'date' WHEN numbers > 0.95 THEN CASE WHEN regexp_matches("column", '(?i)number|block|lot|id$|type$|district|zip|code') THEN 'code' ELSE 'number' END ELSE 'text' END AS kind FROM s),
        t AS (SELECT "column", CASE WHEN kind = 'date' THEN left(v, 10) ELSE v END AS v, sum(n) AS n FROM g JOIN k USING ("column") GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM t),
        e AS (SELECT "column", string_agg(left(v, 28), '; ' ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY 1),
        y AS (SELECT "column", period, count(*) AS n, count(*) FILTER (trim(v) <> '') AS n_filled FROM l GROUP BY ALL),
        z AS (SELECT "column", sum(n)::BIGINT AS n, sum(n_filled)::BIGINT AS n_filled, min((n_filled / n, period)) FILTER (period <> 'none') AS low, max((n_filled / n, period)) FILTER (period <> 'none') AS high FROM y GROUP BY 1)
        SELECT "column", coalesce(kind, 'text') AS kind, n, n_filled, n_filled / n AS populated, coalesce(n_distinct, 0) AS n_distinct, coalesce(examples, '') AS examples,
               CASE WHEN n_filled / n < 0.01 THEN 'hardly filled' WHEN high[1] - low[1] > 0.5 THEN printf('%.1f%% in %s, %.1f%% in %s', round(100 * low[1], 1), low[2], round(100 * high[1], 1), high[2]) ELSE '' END AS note
        FROM z LEFT JOIN k USING ("column") LEFT JOIN e USING ("column")""",
    "client_filled": f"""
        WITH l AS ({_LONG}) SELECT "column", period, count(*) AS n, count(*) FILTER (trim(v) <> '') AS n_filled, count(*) FILTER (trim(v) <> '') / count(*) AS share FROM l GROUP BY ALL""",
    "sale_set_coverage": f"""
        WITH q AS (SELECT *, {_PAIR} AS pair, lpad(vendor_id::VARCHAR, 4, '0') AS vendor FROM sale_lines),
        w AS (SELECT q.pair, q.vendor, q.vendor || lpad(i.size::VARCHAR, 6, '0') AS mapped FROM q LEFT JOIN (SELECT item_id, min(size) AS size FROM items GROUP BY 1) i USING (item_id) WHERE shipped_at < TIMESTAMP '2024-02-15'),
        e AS (SELECT sale_id, pair, left(pair, 4) AS block FROM q WHERE shipped_at >= TIMESTAMP '2024-03-01' AND sale_id IS NOT NULL),
        s AS (SELECT sale_id, bool_or(pair IS NOT NULL) AS has_key, coalesce(bool_or(pair IN (SELECT pair FROM w WHERE pair IS NOT NULL)), false) AS hit, coalesce(bool_or(pair IN (SELECT mapped FROM w WHERE mapped IS NOT NULL)), false) AS mapped,
                     coalesce(bool_or(pair IN (SELECT w.pair FROM w SEMI JOIN (SELECT pair FROM q WHERE shipped_at >= TIMESTAMP '2024-05-01') l ON l.pair = w.pair)), false) AS active,
                     coalesce(bool_or(block IN (SELECT vendor FROM w WHERE vendor IS NOT NULL)), false) AS b FROM e GROUP BY 1)
        SELECT status, count(*) AS items, count(*) FILTER (has_key) AS with_key, count(*) FILTER (hit) AS joined, count(*) FILTER (mapped) AS joined_map, count(*) FILTER (active) AS joined_active,
               count(*) FILTER (hit AND NOT active) AS retired_only, count(*) FILTER (NOT hit AND b) AS block_only, count(*) FILTER (has_key AND NOT hit AND NOT b) AS no_block
        FROM s LEFT JOIN (SELECT sale_id, min(status) AS status FROM sales GROUP BY 1) USING (sale_id) GROUP BY 1""",
    "client_risk_steps": f"""
        WITH {_MONTHS},
        d AS (SELECT p.*, CASE WHEN segment = 'public' THEN 1 WHEN segment = '' THEN 2 WHEN city IS NULL THEN 3 ELSE 4 END AS depth,
                     (client_id, month) IN (SELECT (client_id, date_trunc('month', sold_at)::DATE) FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL) AS sold FROM p),
        r AS (SELECT step, count(DISTINCT client_id) AS units, count(client_id) AS unit_periods, count(*) FILTER (sold) AS events FROM range(0, 4) t(step) LEFT JOIN d ON depth > step GROUP BY 1)
        SELECT step::INT AS step, ['every month', 'not public that month', 'a segment in force', 'a city known'][step + 1] AS rule, units, unit_periods, events, coalesce(lag(events) OVER (ORDER BY step) - events, 0) AS events_lost, 10000 * events / nullif(unit_periods, 0) AS rate FROM r""",
    "client_risk_items": f"""
        WITH {_MONTHS},
        s AS (SELECT sale_id, coalesce(priority::VARCHAR, '(blank)') AS priority, bool_or(segment NOT IN ('public', '') AND city IS NOT NULL) AS k FROM sales JOIN p ON p.client_id = sales.client_id AND month = date_trunc('month', sold_at)::DATE WHERE sale_id IS NOT NULL GROUP BY ALL)
        SELECT priority, count(*) AS in_panel, count(*) FILTER (k) AS kept FROM s GROUP BY 1""",
    "sale_rolls": """
        WITH r AS (SELECT client_id, seq AS number, date_trunc('hour', valid_at) AS hour, city, change_id FROM client_changes),
        a AS (SELECT client_id, number, min(change_id) AS v1 FROM r WHERE number IS NOT NULL GROUP BY ALL), b AS (SELECT client_id, hour, min(change_id) AS v2 FROM r WHERE hour IS NOT NULL GROUP BY ALL),
        c AS (SELECT hour, min(change_id) AS v3 FROM r GROUP BY 1 HAVING count(*) = 1), e AS (SELECT hour, city, min(change_id) AS v4 FROM r WHERE city IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
        s AS (SELECT sale_id, client_id, priority * 7 AS number, date_trunc('hour', sold_at) AS hour, city FROM sales LEFT JOIN (SELECT client_id, arg_min(city, (updated_at, city)) AS city FROM clients GROUP BY 1) USING (client_id)),
        o AS (SELECT CASE WHEN v1 IS NOT NULL THEN 'ordinal' WHEN v2 IS NOT NULL THEN 'date' WHEN v3 IS NOT NULL THEN 'only' WHEN v4 IS NOT NULL THEN 'token' ELSE 'none' END AS how, coalesce(v1, v2, v3, v4) AS v
              FROM s LEFT JOIN a USING (client_id, number) LEFT JOIN b USING (client_id, hour) LEFT JOIN c USING (hour) LEFT JOIN e USING (hour, city))
        SELECT how, count(*) AS n, sum(v)::BIGINT AS changes FROM o GROUP BY 1""",
    "item_labels": rf"""
        WITH x AS (SELECT item_id, list_filter(list_transform(string_split(concat_ws('; ', name, brand, kind), '; '), lambda e: {_FIRST_RULE}), lambda s: s IS NOT NULL) AS t FROM items)
        SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(t, lambda s: s.label))), ',') AS labels, array_to_string(list_sort(list_distinct(list_filter(list_transform(t, lambda s: s.note), lambda n: n <> ''))), ',') AS notes FROM x""",
    "sale_universe": """
        WITH s AS (SELECT *, strftime(sold_at, '%Y-%m') AS month FROM sales),
        c AS (SELECT month, quantile_cont(total, 0.95) AS cut FROM s WHERE status = 'done' AND month IS NOT NULL AND isfinite(total) GROUP BY 1),
        r AS (SELECT sale_id, month, coalesce(status = 'held', false) AS held, coalesce(priority = 1 AND status = 'open', false) AS urgent, coalesce(date_diff('day', sold_at::DATE, arrived_at::DATE) > 3, false) AS late,
                     coalesce(total IS NULL OR total <= 0, false) AS unpriced, coalesce(status = 'done' AND total >= cut, false) AS dear FROM s LEFT JOIN c USING (month))
        SELECT * FROM r WHERE held OR urgent OR late OR unpriced OR dear""",
    "client_record_tests": r"""
        WITH c AS (SELECT source, email, lower(trim(email)) AS address, regexp_replace(lower(trim(email)), '\d+@.*$', '') AS stem FROM clients), w AS (SELECT * FROM c WHERE source = 'web'),
        o AS (SELECT source, email <> '' AND email IN (SELECT email FROM w WHERE email IS NOT NULL) AS a, address <> '' AND address IN (SELECT address FROM w WHERE address IS NOT NULL) AS b, stem <> '' AND stem IN (SELECT stem FROM w WHERE stem IS NOT NULL) AS d FROM c WHERE source <> 'web')
        SELECT source, count(*) AS n, count(*) FILTER (a) AS j_raw, count(*) FILTER (b) AS j_key, count(*) FILTER (d) AS j_stem, count(*) FILTER (a OR b OR d) AS j_any FROM o GROUP BY 1""",
}
