"""Rules of law over projects, and what is left of the text pipeline: obligations, headers, blocks, decisions, inventories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.functions import headers as H
from panelspark.functions import itemfields as I
from panelspark.operators import rules as U
from panelspark.session import spread, table


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects: units by quantity, filed on the order's day, vested at the last shipment."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("units"), F.max("l_shipdate").alias("vest"))
    return table(spark, d, "orders").join(l, "o_orderkey").select("o_orderkey", "units", F.year("o_orderdate").alias("filed"), F.year("vest").alias("year"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def inclusionary_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Shares owed by the first regime that fits a project: small ones none, then by filing year and size, rental or owned; the share escalates by year to a cap."""
    rent = F.col("o_orderstatus") == "O"
    ladder = [
        ("exempt", F.col("units") < 10, {"onsite": 0.0, "fee": 0.0}),
        ("grandfathered", (F.col("filed") < 1997) & (F.col("units") >= 25), {"onsite": 13.5, "fee": 25.0}),
        ("small", F.col("units") < 25, {"onsite": 12.0, "fee": 20.0}),
        ("rental", rent, {"onsite": U.escalated(F.lit(18.0), 0.5, F.col("filed"), 1998, 20.0), "fee": 30.0}),
        ("owned", F.lit(True), {"onsite": U.escalated(F.lit(20.0), 0.5, F.col("filed"), 1998, 21.0), "fee": 33.0}),
    ]
    p = _projects(spark, d).withColumn("terms", U.first_regime(ladder, ["onsite", "fee"])).select("*", "terms.*")
    return p.groupBy("regime", "filed").agg(F.count("*").alias("n"), F.avg("onsite").alias("onsite"), F.sum(F.col("units") * F.col("fee") / 100).alias("fee_units"))


def _register(spark: SparkSession) -> DataFrame:
    """Fixed rates of four sections by year; the last section has a gap before 1997."""
    rows = [(s, y, float(base + step * (y - 1995))) for s, base, step, first, last in (("1-URGENT", 10, 1, 1995, 2000), ("2-HIGH", 8, 2, 1995, 1999), ("3-MEDIUM", 6, 0, 1995, 2001), ("5-LOW", 4, 1, 1997, 1998)) for y in range(first, last + 1)]
    return spark.createDataFrame(rows, "section string, year int, rate double")


def obligations(spark: SparkSession, d: str) -> DataFrame:
    """What projects owe: the register's rate at vesting held to its last year, by units in two tiers, a third off from 1999 to 2000, and a transit fee; totals only where all parts are known."""
    p = _projects(spark, d).withColumnRenamed("o_orderpriority", "section")
    r = U.register_rate(p, _register(spark), "year", "section", "rate")
    relief = F.when(F.col("year").between(1999, 2000), 2 / 3).otherwise(1.0)
    impact = U.tiered(F.col("units"), 99.0, F.col("rate"), F.col("rate") * 1.5) * relief
    transit = F.when(F.col("filed") >= 1996, F.col("units") * 2.0).when(F.col("filed") == 1995, 0.0)
    o = r.withColumn("impact", impact).withColumn("transit", transit).withColumn("total", U.whole_total([F.col("impact"), F.col("transit")]))
    return o.groupBy("section").agg(F.count("*").alias("n"), F.count("total").alias("n_whole"), F.count_if("rate_clamped").alias("n_clamped"), F.sum("impact").alias("impact"), F.sum("total").alias("total"))


def notch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Projects by units about the thresholds 10, 25 and 99: how many at, one below and one above, and the ratio of below to above."""
    p = _projects(spark, d)
    t = p.withColumn("edge", F.explode(F.array(F.lit(10), F.lit(25), F.lit(99)))).where(F.abs(F.col("units") - F.col("edge")) <= 5)
    g = t.groupBy("edge").agg(F.count_if(F.col("units") < F.col("edge")).alias("below"), F.count_if(F.col("units") == F.col("edge")).alias("at"), F.count_if(F.col("units") > F.col("edge")).alias("above"))
    return g.withColumn("ratio", F.col("below") / F.nullif("above", F.lit(0)))


def header_prefill(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a meeting from the lines about its header: place, clock, people present and absent, presiding, by regular windows."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("CITY COMMISSION\nRoom "), k % 400, F.lit(", City Hall\nThursday, May "), k % 28 + 1, F.lit(", 1999\n"), k % 3 + 1, F.lit(":30 PM\nPRESENT: Lee, Wu"), F.when(k % 2 == 0, ", Roe").otherwise(""), F.lit("\nABSENT: "), F.when(k % 2 == 1, "Roe").otherwise("none"), F.lit("\nTHE MEETING WAS CALLED TO ORDER BY PRESIDENT "), F.when(k % 3 == 0, "LEE").otherwise("WU"), F.lit(" AT 1:35 PM"))
    day = F.concat(F.lit("Thursday, May "), k % 28 + 1, F.lit(", 1999"))
    h = spread(table(spark, d, "customer").select("c_custkey")).select(text.alias("t"), H.fields(text, day).alias("h"))
    m = h.select(
        F.regexp_extract("t", r"Room (\d+)", 1).try_cast("int").alias("room"), F.col("h.meeting_time").alias("clock"),
        F.size("h.present").alias("present"), F.size("h.absent").alias("absent"), F.col("h.presiding").alias("presiding"),
    )
    return m.groupBy("presiding", "clock", "present", "absent").agg(F.count("*").alias("n"), F.max("room").alias("largest_room"))


def block_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of an item's block: case, action, motion, votes, district, by one pattern each; how many blocks give each, and with what."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("5. 2015-"), F.lpad(k.cast("string"), 6, "0"), F.when(k % 2 == 0, "CUA").otherwise("DRP"), F.lit(" (J. SMITH) 12 Elm St, in a "), F.when(k % 3 == 0, "RH-2").otherwise("NC-3"), F.lit(" (HOUSE) District.\nACTION: "), F.when(k % 4 == 0, "Disapproved").when(k % 4 == 1, "Approved with conditions").otherwise("Continued to June 1"), F.lit("\nAYES: Lee, Wu\nNOES: "), F.when(k % 5 == 0, "Roe").otherwise("none"), F.when(k % 4 < 2, F.concat(F.lit("\nMOTION: "), k + 100)).otherwise(""))
    f = spread(table(spark, d, "part").select("p_partkey")).select(I.fields(text).alias("f")).select("f.*")
    action = F.when((F.col("action") == "approved") & (F.col("conditions_imposed") == "yes"), "approved_with_conditions").otherwise(F.col("action"))
    b = f.select(F.col("request_type").alias("request"), action.alias("action"), F.col("type_district").alias("district"), F.col("action_instrument_no").alias("motion"), (F.size("noes") > 0).alias("dissent"))
    return b.groupBy("request", "action", "district").agg(F.count("*").alias("n"), F.count("motion").alias("n_motions"), F.max("motion").alias("last_motion"), F.count_if("dissent").alias("n_dissent"))


def snapped_headers(spark: SparkSession, d: str) -> DataFrame:
    """The line of each page that is most like a header by a score of four parts, at least 3: first, short, capitalised, without an end; the first of ties."""
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", r"\n")).alias("line", "said")).where("trim(said) <> ''")
    score = (F.col("line") == 0).cast("int") + (F.length("said") <= 60).cast("int") + F.col("said").rlike(r"^[A-Z]").cast("int") + (~F.col("said").rlike(r"[.!?]\s*$")).cast("int")
    best = lines.withColumn("score", score).groupBy("doc_id", "lang").agg(F.max_by(F.struct("line", "score"), F.struct("score", -F.col("line"))).alias("b")).select("doc_id", "lang", "b.*")
    return best.groupBy("lang", F.when(F.col("score") >= 3, F.col("score")).alias("score")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def decision_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Blocks cut where a later decision carries a number of its own; the first fragment keeps the id, the others are new."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("Item A. MOTION: "), k, F.lit(" adopted."), F.when(k % 2 == 0, F.concat(F.lit("\nItem B. MOTION: "), k + 1, F.lit(" adopted."))).otherwise(""), F.when(k % 6 == 0, "\nItem C. MOTION: none.").otherwise(""))
    cut = F.split(text, r"\n(?=Item [A-Z]\. MOTION: \d)")
    f = table(spark, d, "part").select("p_partkey", F.posexplode(cut).alias("place", "body")).withColumn("kept", F.col("place") == 0)
    return f.groupBy("place", "kept").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.max(F.regexp_extract("body", r"MOTION: (\d+)", 1).try_cast("int")).alias("last_motion"))


def catalogue_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Key columns of all tables by the words of their names: in how many tables the word stands, of how many types, how many values there are and how far they reach."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")
    each = None
    for t in names:
        df = table(spark, d, t)
        keys = [f for f in df.schema if re.search(r"key$|_id$", f.name)]
        # One pass over a table's key columns, one row out.
        read = df.agg(*[F.struct(F.lit(re.sub(r"^[a-z]_", "", f.name)).alias("word"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("n"), F.max(F.col(f.name).cast("long")).alias("most")).alias(f.name) for f in keys])
        rows = read.select(F.explode(F.array(*[f.name for f in keys])).alias("k")).select(F.lit(t).alias("source"), "k.*")
        each = rows if each is None else each.unionByName(rows)
    return each.groupBy("word").agg(F.countDistinct("source").alias("n_tables"), F.min("source").alias("first_table"), F.countDistinct("type").alias("n_types"), F.sum("n").alias("n_values"), F.max("most").alias("greatest"))


def packet_availability(spark: SparkSession, d: str) -> DataFrame:
    """Of a sample of ten orders a year and status, by an arithmetic order, whether each family of papers is there: lines returned, dear, late."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderdate")
    s = o.withColumn("r", F.row_number().over(W.partitionBy("year", "o_orderstatus").orderBy(F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)), "o_orderkey"))).where("r <= 10")
    l = table(spark, d, "lineitem").join(s, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_extendedprice") > 90000).alias("dear"), F.bool_or(F.col("l_shipdate") > F.col("o_orderdate")).alias("late"))
    have = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return s.join(l, "o_orderkey", "left").groupBy("year").agg(F.count("*").alias("n"), have("returned"), have("dear"), have("late"))


def artefact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every artefact as metrics of unique names."""
    from panelspark.sources import sinks

    parts = {t: table(spark, d, t).agg(F.count("*").alias(f"n_{t}")) for t in ("orders", "lineitem", "documents", "events")}
    parts["spans"] = table(spark, d, "orders").agg(F.countDistinct(F.year("o_orderdate")).alias("n_years"), F.countDistinct("o_custkey").alias("n_buyers"))
    return sinks.metrics(parts)


def content_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Labels put back by content: documents whose text is that of a labelled one take its label where all agree (AUTO), are flagged where they don't (FLAG), else none."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    l = docs.join(table(spark, d, "labels"), "doc_id").groupBy("h").agg(F.min("quality").alias("a"), F.max("quality").alias("b"), F.count("*").alias("k"))
    rest = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").join(l, "h", "left")
    status = F.when(F.col("k").isNull(), "none").when(F.col("a") == F.col("b"), "AUTO").otherwise("FLAG")
    return rest.groupBy(status.alias("status"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("quality")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (inclusionary_ladder, obligations, notch_counts, header_prefill, block_fields, snapped_headers, decision_fragments, catalogue_inventory, packet_availability, artefact_counts, content_proposals)}

_P = "p AS (SELECT o_orderkey, q AS units, year(o_orderdate)::INT AS filed, year(v)::INT AS year, o_orderstatus, o_orderpriority FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, max(l_shipdate) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"

ORACLE_SQL = {
    "inclusionary_ladder": f"""
        WITH {_P}, r AS (SELECT *, CASE WHEN units < 10 THEN 'exempt' WHEN filed < 1997 AND units >= 25 THEN 'grandfathered' WHEN units < 25 THEN 'small' WHEN o_orderstatus = 'O' THEN 'rental' ELSE 'owned' END AS regime FROM p),
        t AS (SELECT *, CASE regime WHEN 'exempt' THEN 0 WHEN 'grandfathered' THEN 13.5 WHEN 'small' THEN 12 WHEN 'rental' THEN least(18 + 0.5 * greatest(filed - 1998, 0), 20) ELSE least(20 + 0.5 * greatest(filed - 1998, 0), 21) END::DOUBLE AS onsite,
                     CASE regime WHEN 'exempt' THEN 0 WHEN 'grandfathered' THEN 25 WHEN 'small' THEN 20 WHEN 'rental' THEN 30 ELSE 33 END::DOUBLE AS fee FROM r)
        SELECT regime, filed, count(*) AS n, avg(onsite) AS onsite, sum(units * fee / 100) AS fee_units FROM t GROUP BY 1, 2""",
    "obligations": f"""
        WITH {_P}, s AS (SELECT *, o_orderpriority AS section, CASE o_orderpriority WHEN '1-URGENT' THEN 2000 WHEN '2-HIGH' THEN 1999 WHEN '3-MEDIUM' THEN 2001 WHEN '5-LOW' THEN 1998 END AS last FROM p),
        r AS (SELECT *, least(year, last) AS y, coalesce(year > last, FALSE) AS clamped, CASE section WHEN '1-URGENT' THEN 10 + least(year, last) - 1995 WHEN '2-HIGH' THEN 8 + 2 * (least(year, last) - 1995) WHEN '3-MEDIUM' THEN 6 WHEN '5-LOW' THEN CASE WHEN year >= 1997 THEN 4 + least(year, last) - 1995 END END::DOUBLE AS rate FROM s),
        i AS (SELECT *, (least(units, 99) * rate + greatest(units - 99, 0) * rate * 1.5) * CASE WHEN year BETWEEN 1999 AND 2000 THEN 2.0::DOUBLE / 3 ELSE 1 END AS impact, CASE WHEN filed >= 1996 THEN units * 2.0 WHEN filed = 1995 THEN 0 END AS transit FROM r)
        SELECT section, count(*) AS n, count(impact + transit) AS n_whole, count(*) FILTER (clamped) AS n_clamped, sum(impact) AS impact, sum(impact + transit) AS total FROM i GROUP BY 1""",
    "notch_counts": f"""
        WITH {_P}, t AS (SELECT units, edge FROM p, (VALUES (10), (25), (99)) e(edge) WHERE abs(units - edge) <= 5)
        SELECT edge, count(*) FILTER (units < edge) AS below, count(*) FILTER (units = edge) AS at, count(*) FILTER (units > edge) AS above, count(*) FILTER (units < edge) / nullif(count(*) FILTER (units > edge), 0) AS ratio FROM t GROUP BY 1""",
    "header_prefill": """
        SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Lee' ELSE 'Wu' END AS presiding, (c_custkey % 3 + 1) || ':30 PM' AS clock, (2 + (c_custkey % 2 = 0)::INT) AS present, (c_custkey % 2)::INT AS absent, count(*) AS n, max(c_custkey % 400)::INT AS largest_room FROM customer GROUP BY 1, 2, 3, 4""",
    "block_fields": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'conditional_use' ELSE 'discretionary_review' END AS request, CASE p_partkey % 4 WHEN 0 THEN 'disapproved' WHEN 1 THEN 'approved_with_conditions' ELSE 'continued' END AS action, CASE WHEN p_partkey % 3 = 0 THEN 'RH-2' ELSE 'NC-3' END AS district,
               count(*) AS n, count(*) FILTER (p_partkey % 4 < 2) AS n_motions, (max(p_partkey) FILTER (p_partkey % 4 < 2) + 100)::INT AS last_motion, count(*) FILTER (p_partkey % 5 = 0) AS n_dissent FROM part GROUP BY 1, 2, 3""",
    "snapped_headers": r"""
        WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        c AS (SELECT *, (i = 0)::INT + (length(s) <= 60)::INT + regexp_matches(s, '^[A-Z]')::INT + (NOT regexp_matches(s, '[.!?]\s*$'))::INT AS score FROM l WHERE trim(s) <> ''), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1)
        SELECT lang, CASE WHEN score >= 3 THEN score END AS score, count(*) AS n, sum(i)::BIGINT AS lines FROM b GROUP BY 1, 2""",
    "decision_fragments": """
        WITH f AS (SELECT 0 AS place, p_partkey AS m, 'Item A. MOTION: ' || p_partkey || ' adopted.' || CASE WHEN p_partkey % 6 = 0 AND p_partkey % 2 = 1 THEN chr(10) || 'Item C. MOTION: none.' ELSE '' END AS b FROM part
                   UNION ALL SELECT 1, p_partkey + 1, 'Item B. MOTION: ' || (p_partkey + 1) || ' adopted.' || CASE WHEN p_partkey % 6 = 0 THEN chr(10) || 'Item C. MOTION: none.' ELSE '' END FROM part WHERE p_partkey % 2 = 0)
        SELECT place, place = 0 AS kept, count(*) AS n, sum(length(b))::BIGINT AS chars, max(m)::INT AS last_motion FROM f GROUP BY 1""",
    "catalogue_inventory": """
        WITH c(t, w, k, n, m) AS (
            SELECT 'region', 'regionkey', typeof(any_value(r_regionkey)), count(r_regionkey), max(r_regionkey)::BIGINT FROM region UNION ALL
            SELECT 'nation', 'nationkey', typeof(any_value(n_nationkey)), count(n_nationkey), max(n_nationkey)::BIGINT FROM nation UNION ALL
            SELECT 'nation', 'regionkey', typeof(any_value(n_regionkey)), count(n_regionkey), max(n_regionkey)::BIGINT FROM nation UNION ALL
            SELECT 'customer', 'custkey', typeof(any_value(c_custkey)), count(c_custkey), max(c_custkey)::BIGINT FROM customer UNION ALL
            SELECT 'customer', 'nationkey', typeof(any_value(c_nationkey)), count(c_nationkey), max(c_nationkey)::BIGINT FROM customer UNION ALL
            SELECT 'supplier', 'suppkey', typeof(any_value(s_suppkey)), count(s_suppkey), max(s_suppkey)::BIGINT FROM supplier UNION ALL
            SELECT 'supplier', 'nationkey', typeof(any_value(s_nationkey)), count(s_nationkey), max(s_nationkey)::BIGINT FROM supplier UNION ALL
            SELECT 'part', 'partkey', typeof(any_value(p_partkey)), count(p_partkey), max(p_partkey)::BIGINT FROM part UNION ALL
            SELECT 'orders', 'orderkey', typeof(any_value(o_orderkey)), count(o_orderkey), max(o_orderkey)::BIGINT FROM orders UNION ALL
            SELECT 'orders', 'custkey', typeof(any_value(o_custkey)), count(o_custkey), max(o_custkey)::BIGINT FROM orders UNION ALL
            SELECT 'lineitem', 'orderkey', typeof(any_value(l_orderkey)), count(l_orderkey), max(l_orderkey)::BIGINT FROM lineitem UNION ALL
            SELECT 'lineitem', 'partkey', typeof(any_value(l_partkey)), count(l_partkey), max(l_partkey)::BIGINT FROM lineitem UNION ALL
            SELECT 'lineitem', 'suppkey', typeof(any_value(l_suppkey)), count(l_suppkey), max(l_suppkey)::BIGINT FROM lineitem UNION ALL
            SELECT 'events', 'event_id', typeof(any_value(event_id)), count(event_id), max(event_id)::BIGINT FROM events UNION ALL
            SELECT 'events', 'user_id', typeof(any_value(user_id)), count(user_id), max(user_id)::BIGINT FROM events UNION ALL
            SELECT 'documents', 'doc_id', typeof(any_value(doc_id)), count(doc_id), max(doc_id)::BIGINT FROM documents UNION ALL
            SELECT 'embeddings', 'vec_id', typeof(any_value(vec_id)), count(vec_id), max(vec_id)::BIGINT FROM embeddings UNION ALL
            SELECT 'pages', 'page_id', typeof(any_value(page_id)), count(page_id), max(page_id)::BIGINT FROM pages UNION ALL
            SELECT 'labels', 'doc_id', typeof(any_value(doc_id)), count(doc_id), max(doc_id)::BIGINT FROM labels UNION ALL
            SELECT 'conversations', 'conv_id', typeof(any_value(conv_id)), count(conv_id), max(conv_id)::BIGINT FROM conversations)
        SELECT w AS word, count(DISTINCT t) AS n_tables, min(t) AS first_table, count(DISTINCT k) AS n_types, sum(n)::BIGINT AS n_values, max(m) AS greatest FROM c GROUP BY 1""",
    "packet_availability": """
        WITH s AS (SELECT o_orderkey, o_orderdate, year(o_orderdate)::INT AS year FROM orders QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY o_orderkey * 7919 % 10007, o_orderkey) <= 10),
        l AS (SELECT o_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_extendedprice > 90000) AS x, bool_or(l_shipdate > o_orderdate) AS t FROM s JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT year, count(*) AS n, count(*) FILTER (r) AS returned, count(*) FILTER (x) AS dear, count(*) FILTER (t) AS late FROM s LEFT JOIN l USING (o_orderkey) GROUP BY 1""",
    "artefact_counts": """
        SELECT 'n_orders' AS metric, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'n_lineitem', count(*)::VARCHAR FROM lineitem UNION ALL SELECT 'n_documents', count(*)::VARCHAR FROM documents UNION ALL SELECT 'n_events', count(*)::VARCHAR FROM events
        UNION ALL SELECT 'n_years', count(DISTINCT year(o_orderdate))::VARCHAR FROM orders UNION ALL SELECT 'n_buyers', count(DISTINCT o_custkey)::VARCHAR FROM orders""",
    "content_proposals": """
        WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), l AS (SELECT h, min(quality) AS a, max(quality) AS b FROM d JOIN labels USING (doc_id) GROUP BY 1)
        SELECT CASE WHEN l.h IS NULL THEN 'none' WHEN a = b THEN 'AUTO' ELSE 'FLAG' END AS status, CASE WHEN a = b THEN a END AS quality, count(*) AS n FROM d LEFT JOIN l USING (h) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1, 2""",
}
