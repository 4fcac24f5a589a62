"""Linking orders, line items, events and customers: cascades, intervals, as-of, set overlap, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import joins as J
from panelspark.session import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def modal_fallback_district(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's usual customer nation among its line items, else its own nation's usual market segment holder."""
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    seen = _lines(spark, d).where("l_quantity > 40").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by_supplier = J.modal(seen, ["l_suppkey"], "c_mktsegment", "exact")
    by_nation = J.modal(customers.withColumnRenamed("c_nationkey", "s_nationkey"), ["s_nationkey"], "c_mktsegment", "coarse")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = s.join(by_supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(by_nation, "s_nationkey", "left")
    return out.select("s_suppkey", F.coalesce("exact", "coarse").alias("segment"), F.when(F.col("exact").isNotNull(), "supplier").when(F.col("coarse").isNotNull(), "nation").otherwise("none").alias("how"))


def cascade_case_match(spark: SparkSession, d: str) -> DataFrame:
    """Line items to a large order: by order key, else by part and supplier, else by part; ambiguous keys match none."""
    orders = table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey")
    big = _lines(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_partkey", "l_suppkey").withColumnRenamed("l_orderkey", "hit")
    left = _lines(spark, d).where("l_quantity = 50").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    exact = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("hit"))
    tiers = [("order", exact, ["l_orderkey"]), ("part_supplier", J.unique_key(big, ["l_partkey", "l_suppkey"], "hit"), ["l_partkey", "l_suppkey"]), ("part", J.unique_key(big, ["l_partkey"], "hit"), ["l_partkey"])]
    return J.cascade_join(left, tiers, "hit").select("l_orderkey", "l_partkey", "l_suppkey", "n", "hit", "how")


def _filed(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"))
    return _lines(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("cust", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.to_date("l_shipdate").alias("shipped"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("heard"))


def range_window_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Shipments to the same customer from 1095 days before to 365 days after an urgent order: how many, and the largest price."""
    pairs = J.interval_join(_cases(spark, d), _filed(spark, d).where("l_extendedprice > 50000"), ["cust"], "heard", "shipped", 1095, 365)
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("max_price"))


def nearest_k_filings(spark: SparkSession, d: str) -> DataFrame:
    """The three shipments nearest in time to each urgent order, within the same window."""
    pairs = J.interval_join(_cases(spark, d), _filed(spark, d).distinct(), ["cust"], "heard", "shipped", 1095, 365)
    ranked = J.nearest_k(pairs, ["o_orderkey"], F.datediff("shipped", "heard"), ["shipped", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 3)
    return ranked.select("o_orderkey", "rank", "l_orderkey", "l_linenumber", F.datediff("shipped", "heard").alias("gap"))


def within_window_exists(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders with any dear shipment to the customer within three years either way, by year."""
    hit = J.interval_join(_cases(spark, d), _filed(spark, d).where("l_extendedprice > 80000"), ["cust"], "heard", "shipped", 1095, 1095, "left_semi").select("o_orderkey", F.lit(1).alias("hit"))
    both = _cases(spark, d).join(hit, "o_orderkey", "left")
    return both.groupBy(F.year("heard").alias("year")).agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"))


def next_event_asof(spark: SparkSession, d: str) -> DataFrame:
    """For each error the user's next purchase on or after it, else a mark that all are before."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("at"))
    out = J.next_event(left, e.where("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "at", "ts")
    return out.select("event_id", "user_id", "next", (F.col("next").isNull() & F.col("last").isNotNull()).alias("all_before"))


def latest_before_asof(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the value of the user's latest click before it."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("clicked"))
    return J.latest_before(left, right, ["user_id"], "at", "ts", "clicked").select("event_id", "clicked")


def nearest_year_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Each order's median customer price of its year, the year clamped to 1996-1999."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    roll = o.where("year between 1996 and 1999").groupBy("o_custkey", F.col("year").alias("roll_year")).agg(F.median("o_totalprice").alias("median_price"))
    left = o.where("o_totalprice > 450000").withColumn("roll_year", J.clamp(F.col("year"), 1996, 1999))
    return left.join(roll, ["o_custkey", "roll_year"], "left").select("o_orderkey", "roll_year", "median_price")


def panel_expand_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """A row for each customer and year from first to last order; the latest yearly maximum carried forward."""
    o = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    span = o.groupBy("o_custkey").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    best = o.groupBy("o_custkey", "year").agg(F.max("o_totalprice").alias("price"))
    panel = J.panel_years(span, "first", "last").join(best, ["o_custkey", "year"], "left")
    return panel.select("o_custkey", "year", F.col("price").isNotNull().alias("observed"), J.ever_since(panel, ["o_custkey"], ["year"], "price").alias("price"))


RULES = [(r"^PROMO", "promo"), (r"^ECONOMY", "economy"), (r"(STEEL|TIN)", "metal"), (r"[AEIOU]$", "vowel")]


def rule_table_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Part types by the first of an ordered list of patterns."""
    p = J.first_rule(table(spark, d, "part"), "p_type", RULES, "rule")
    return p.groupBy(F.coalesce("rule", F.lit("(none)")).alias("rule")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def set_overlap_join_rates(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose parts are in a layer of dear parts: any, any of size over 25, by status."""
    items = _lines(spark, d).select("l_orderkey", "l_partkey").distinct()
    layer = table(spark, d, "part").where("p_retailprice > 1500").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    flags = J.overlap_flags(items, layer, "l_orderkey", "l_partkey", {"hit": F.col("p_size").isNotNull(), "hit_large": F.col("p_size") > 25})
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return flags.join(o, "l_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), F.count_if("hit_large").alias("n_large"))


def two_hop_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of an urgent order: by its own lines, or those of the customer's other orders of the same day."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'")
    own = urgent.select("o_orderkey", F.col("o_orderkey").alias("via"))
    sib = urgent.join(o.select("o_custkey", "day", F.col("o_orderkey").alias("via")), ["o_custkey", "day"]).select("o_orderkey", "via")
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("via"), "l_suppkey")
    bridge = own.unionByName(sib).distinct().join(lines, "via").select("o_orderkey", "l_suppkey").distinct()
    return bridge.groupBy("o_orderkey").agg(F.count("*").alias("n_suppliers"), F.min("l_suppkey").alias("first_supplier"))


def tier_links(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders by the best tier that links them to a dear shipment: own lines, the window, none."""
    cases, filed = _cases(spark, d), _filed(spark, d).where("l_extendedprice > 90000")
    t1 = cases.join(filed, cases["o_orderkey"] == filed["l_orderkey"], "left_semi").select("o_orderkey", F.lit(1).alias("t1"))
    rest = cases.join(t1, "o_orderkey", "left_anti")
    t3 = J.interval_join(rest, filed, ["cust"], "heard", "shipped", 1095, 365, "left_semi").select("o_orderkey", F.lit(1).alias("t3"))
    both = cases.join(t1, "o_orderkey", "left").join(t3, "o_orderkey", "left")
    return both.groupBy(F.when(F.col("t1") == 1, "T1").when(F.col("t3") == 1, "T3").otherwise("none").alias("tier")).agg(F.count("*").alias("n"))


def semi_anti_counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders of high value, by segment."""
    c = table(spark, d, "customer")
    dear = table(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    have = c.join(dear, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n_with"))
    lack = c.join(dear, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_without"))
    return have.join(lack, "c_mktsegment", "outer")


def outer_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three aggregates by nation, joined outer one after the other."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_rich"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    n = table(spark, d, "nation").where("n_regionkey < 3").groupBy(F.col("n_nationkey").alias("nation")).agg(F.min("n_name").alias("name"))
    return c.join(s, "nation", "outer").join(n, "nation", "outer").na.fill(0, ["n_rich", "n_suppliers"])


def reference_chase(spark: SparkSession, d: str) -> DataFrame:
    """Customers follow a pointer (half of their key, rounded down) up to five hops."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") > 3, F.floor(F.col("c_custkey") / 2).cast("long")).alias("parent"))
    return J.chase(c, "c_custkey", "parent", 5).select("c_custkey", "end", "hops")


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest event of each type."""
    e = table(spark, d, "events")
    return J.latest_wins(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def canonical_copy(spark: SparkSession, d: str) -> DataFrame:
    """One line of each order and line number: returned ones first, then the dearest, then by part and supplier."""
    order = (F.desc(F.col("l_returnflag") == "R"), F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_shipdate"))
    best = J.latest_wins(_lines(spark, d), ["l_orderkey", "l_linenumber"], *order)
    return best.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_partkey")).alias("part_sum"))


def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    """The number of orders kept under a grid of thresholds: a cross join with a fixed handful of parameters."""
    grid = spark.createDataFrame([(t, m) for t in (100000.0, 250000.0, 400000.0) for m in (1.0, 0.8)], "floor_price double, factor double")
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.round("o_totalprice", -3).alias("price")).agg(F.count("*").alias("n"))
    return o.crossJoin(F.broadcast(grid)).where(F.col("price") * F.col("factor") >= F.col("floor_price")).groupBy("year", "floor_price", "factor").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (modal_fallback_district, cascade_case_match, range_window_candidates, nearest_k_filings, within_window_exists, next_event_asof, latest_before_asof, nearest_year_clamped, panel_expand_carry_forward, rule_table_first_match, set_overlap_join_rates, two_hop_bridge, tier_links, semi_anti_counts, outer_chain, reference_chase, latest_wins, canonical_copy, sensitivity_grid)}

_CASES = "cases AS (SELECT o_orderkey, o_custkey AS cust, o_orderdate::DATE AS heard FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"
_FILED = "filed AS (SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate::DATE AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

ORACLE_SQL = {
    "modal_fallback_district": """
        WITH x AS (SELECT l_suppkey, c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 40 GROUP BY ALL),
        a AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, c_mktsegment) = 1),
        y AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
        b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
        SELECT s_suppkey, coalesce(a.c_mktsegment, b.c_mktsegment) AS segment,
               CASE WHEN a.c_mktsegment IS NOT NULL THEN 'supplier' WHEN b.c_mktsegment IS NOT NULL THEN 'nation' ELSE 'none' END AS how
        FROM supplier LEFT JOIN a ON s_suppkey = l_suppkey LEFT JOIN b ON s_nationkey = c_nationkey""",
    "cascade_case_match": """
        WITH o AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000),
        big AS (SELECT l_orderkey AS hit, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
        l AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY ALL),
        ps AS (SELECT l_partkey, l_suppkey, min(hit) AS hit FROM big GROUP BY ALL HAVING min(hit) = max(hit)),
        p AS (SELECT l_partkey, min(hit) AS hit FROM big GROUP BY ALL HAVING min(hit) = max(hit))
        SELECT l.*, coalesce(o.o_orderkey, ps.hit, p.hit) AS hit,
               CASE WHEN o.o_orderkey IS NOT NULL THEN 'order' WHEN ps.hit IS NOT NULL THEN 'part_supplier' WHEN p.hit IS NOT NULL THEN 'part' ELSE 'none' END AS how
        FROM l LEFT JOIN o ON l_orderkey = o_orderkey LEFT JOIN ps USING (l_partkey, l_suppkey) LEFT JOIN p USING (l_partkey)""",
    "range_window_candidates": f"""
        WITH {_CASES}, {_FILED}
        SELECT o_orderkey, count(*) AS n, max(l_extendedprice) AS max_price FROM cases JOIN filed USING (cust)
        WHERE l_extendedprice > 50000 AND date_diff('day', heard, shipped) BETWEEN -1095 AND 365 GROUP BY o_orderkey""",
    "nearest_k_filings": f"""
        WITH {_CASES}, {_FILED}, u AS (SELECT DISTINCT * FROM filed)
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(date_diff('day', heard, shipped)), shipped, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank,
               l_orderkey, l_linenumber, date_diff('day', heard, shipped) AS gap
        FROM cases JOIN u USING (cust) WHERE date_diff('day', heard, shipped) BETWEEN -1095 AND 365 QUALIFY rank <= 3""",
    "within_window_exists": f"""
        WITH {_CASES}, {_FILED}
        SELECT year(heard) AS year, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM filed f WHERE f.cust = c.cust AND l_extendedprice > 80000 AND date_diff('day', c.heard, f.shipped) BETWEEN -1095 AND 1095)) AS n_hit
        FROM cases c GROUP BY 1""",
    "next_event_asof": """
        WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS t FROM events WHERE event_type = 'purchase')
        SELECT event_id, l.user_id, min(t) FILTER (WHERE t >= ts) AS next, min(t) FILTER (WHERE t >= ts) IS NULL AND max(t) IS NOT NULL AS all_before
        FROM l LEFT JOIN p USING (user_id) GROUP BY event_id, l.user_id""",
    "latest_before_asof": """
        WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, ts AS t, value FROM events WHERE event_type = 'click')
        SELECT event_id, arg_max(value, (t, value)) FILTER (WHERE t <= ts) AS clicked FROM l LEFT JOIN p USING (user_id) GROUP BY event_id""",
    "nearest_year_clamped": """
        WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS y FROM orders),
        r AS (SELECT o_custkey, y AS roll_year, median(o_totalprice) AS median_price FROM o WHERE y BETWEEN 1996 AND 1999 GROUP BY ALL)
        SELECT o_orderkey, least(greatest(y, 1996), 1999) AS roll_year, median_price
        FROM o LEFT JOIN r ON o.o_custkey = r.o_custkey AND r.roll_year = least(greatest(y, 1996), 1999) WHERE o_totalprice > 450000""",
    "panel_expand_carry_forward": """
        WITH o AS (SELECT o_custkey, o_totalprice, year(o_orderdate) AS year FROM orders WHERE o_totalprice > 300000),
        p AS (SELECT o_custkey, unnest(generate_series(min(year), max(year))) AS year FROM o GROUP BY o_custkey),
        b AS (SELECT o_custkey, year, max(o_totalprice) AS price FROM o GROUP BY ALL)
        SELECT p.o_custkey, p.year, price IS NOT NULL AS observed, last_value(price IGNORE NULLS) OVER (PARTITION BY p.o_custkey ORDER BY p.year) AS price
        FROM p LEFT JOIN b ON p.o_custkey = b.o_custkey AND p.year = b.year""",
    "rule_table_first_match": """
        SELECT CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, '^ECONOMY') THEN 'economy' WHEN regexp_matches(p_type, '(STEEL|TIN)') THEN 'metal'
                    WHEN regexp_matches(p_type, '[AEIOU]$') THEN 'vowel' ELSE '(none)' END AS rule, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""",
    "set_overlap_join_rates": """
        WITH f AS (SELECT l_orderkey, bool_or(p_retailprice > 1500) AS hit, bool_or(p_retailprice > 1500 AND p_size > 25) AS large FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE large) AS n_large FROM f JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "two_hop_bridge": """
        WITH u AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT'),
        v AS (SELECT o_orderkey, o_orderkey AS via FROM u UNION SELECT u.o_orderkey, o.o_orderkey FROM u JOIN orders o ON o.o_custkey = u.o_custkey AND o.o_orderdate::DATE = u.day)
        SELECT o_orderkey, count(DISTINCT l_suppkey) AS n_suppliers, min(l_suppkey) AS first_supplier FROM v JOIN lineitem ON l_orderkey = via GROUP BY 1""",
    "tier_links": f"""
        WITH {_CASES}, {_FILED}, dear AS (SELECT * FROM filed WHERE l_extendedprice > 90000)
        SELECT CASE WHEN EXISTS (SELECT 1 FROM dear WHERE l_orderkey = o_orderkey) THEN 'T1'
                    WHEN EXISTS (SELECT 1 FROM dear WHERE dear.cust = cases.cust AND date_diff('day', heard, shipped) BETWEEN -1095 AND 365) THEN 'T3' ELSE 'none' END AS tier, count(*) AS n
        FROM cases GROUP BY 1""",
    "semi_anti_counts": """
        WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 480000)
        SELECT c_mktsegment, nullif(count(o_custkey), 0) AS n_with, nullif(count(*) - count(o_custkey), 0) AS n_without FROM customer LEFT JOIN d ON c_custkey = o_custkey GROUP BY 1""",
    "outer_chain": """
        WITH c AS (SELECT c_nationkey AS nation, count(*) AS n_rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier GROUP BY 1),
        n AS (SELECT n_nationkey AS nation, n_name AS name FROM nation WHERE n_regionkey < 3)
        SELECT nation, coalesce(n_rich, 0) AS n_rich, coalesce(n_suppliers, 0) AS n_suppliers, name FROM c FULL JOIN s USING (nation) FULL JOIN n USING (nation)""",
    "reference_chase": """
        WITH RECURSIVE r AS (SELECT c_custkey, c_custkey AS "end", 0 AS hops FROM customer
                             UNION ALL SELECT c_custkey, "end" // 2, hops + 1 FROM r WHERE "end" > 3 AND hops < 5)
        SELECT c_custkey, arg_max("end", hops) AS "end", max(hops) AS hops FROM r GROUP BY 1""",
    "latest_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "canonical_copy": """
        WITH b AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'R' DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) = 1)
        SELECT l_linenumber, l_returnflag, count(*) AS n, sum(l_partkey)::BIGINT AS part_sum FROM b GROUP BY ALL""",
    "sensitivity_grid": """
        WITH g AS (SELECT * FROM (VALUES (100000.0::DOUBLE), (250000.0), (400000.0)) t(floor_price), (VALUES (1.0::DOUBLE), (0.8)) f(factor))
        SELECT year(o_orderdate) AS year, floor_price, factor, count(*) AS n FROM orders, g WHERE round(o_totalprice, -3) * factor >= floor_price GROUP BY ALL""",
}
