"""Routines of the chronicle: reach, targets, residuals, adjudication, migration, histories and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators import joins as J
from panelspark.session import table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))


def class_at_filing(spark: SparkSession, d: str) -> DataFrame:
    """The class in force when a line was shipped: the customer's main status of that year, years held to 1996..1999, none before 1996; the first match of each."""
    o = _orders(spark, d).groupBy("o_custkey", "year").agg(F.min_by("o_orderstatus", "o_orderkey").alias("cls"))
    l = table(spark, d, "lineitem").join(_orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    filed = l.withColumn("filed", F.year("l_shipdate")).withColumn("year", F.when(F.col("filed") >= 1996, J.clamp(F.col("filed"), 1996, 1999)))
    out = filed.join(o, ["o_custkey", "year"], "left")
    return out.groupBy("filed", "cls").agg(F.count("*").alias("n"))


def text_reach(spark: SparkSession, d: str) -> DataFrame:
    """Orders that have a text by either of two keys: their customer has a dear order, or their priority and day have one."""
    o = _orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    dear = o.where("o_totalprice > 400000")
    by_case = dear.select("o_custkey").distinct().withColumn("case_hit", F.lit(True))
    by_motion = dear.select("o_orderpriority", "day").distinct().withColumn("motion_hit", F.lit(True))
    out = o.join(by_case, "o_custkey", "left").join(by_motion, ["o_orderpriority", "day"], "left")
    hit = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.groupBy("year").agg(F.count("*").alias("n"), F.count_if(hit("case_hit")).alias("by_case"), F.count_if(hit("motion_hit")).alias("by_motion"), F.count_if(hit("case_hit") | hit("motion_hit")).alias("reached"))


def discovered_links(spark: SparkSession, d: str) -> DataFrame:
    """Candidate links from four sources under one schema, the key from the link's own words, each link once under its first source."""
    p = table(spark, d, "pages")
    own = F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1)
    anchors = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("url"))
    parts = [(0, "self", p.select("page_id", "url")), (1, "anchor", anchors), (2, "upper", p.select("page_id", F.regexp_replace("url", r"/[^/]*$", "/").alias("url"))), (3, "secure", p.select("page_id", F.regexp_replace("url", "^http://", "https://").alias("url")))]
    every = None
    for rank, name, df in parts:
        one = df.select("url", F.lit(rank).alias("rank"), F.lit(name).alias("source"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("url").agg(F.min_by("source", "rank").alias("source"))
    return first.withColumn("key", own).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("key") != "").alias("n_keyed"))


def pull_targets(spark: SparkSession, d: str) -> DataFrame:
    """What is still to fetch: pages not answered, one of each host and path, those of labelled documents first, then by host and id; archive rows only where the live page failed."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), (F.length("html") < 400).alias("failed"))
    todo = p.where("page_id % 3 <> 0 or failed")
    first = J.latest_wins(todo, ["host", "path"], F.col("page_id"))
    marked = first.join(table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.lit(1).alias("labelled")), "page_id", "left")
    order = W.partitionBy("host").orderBy(F.asc_nulls_last("labelled"), "page_id")
    return marked.withColumn("place", F.row_number().over(order)).groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_archive"), F.min_by("page_id", "place").alias("first_page"))


def modal_type_per_case(spark: SparkSession, d: str) -> DataFrame:
    """Lines of canonical orders with the most frequent priority of their customer, by that."""
    o = _orders(spark, d)
    modal = J.modal(o, ["o_custkey"], "o_orderpriority", "modal")
    canonical = J.latest_wins(o, ["o_custkey", "year"], F.desc("o_totalprice"), F.col("o_orderkey")).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    l = table(spark, d, "lineitem").join(canonical, "l_orderkey").join(modal, "o_custkey")
    return l.groupBy("modal").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), F.sum("l_quantity").alias("quantity"))


def residual_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a returned line, by the reason: open, young, small, or none of these; with the first keys of each, sorted."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rest = _orders(spark, d).join(back, "o_orderkey", "left_anti")
    reason = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("year") >= 2000, "young").when(F.col("o_totalprice") < 50000, "small").otherwise("other")
    ranked = rest.withColumn("reason", reason).withColumn("place", F.row_number().over(W.partitionBy("reason").orderBy("o_orderkey")))
    return ranked.groupBy("reason").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("o_orderkey")))), lambda x: x.cast("string")), ",").alias("first_keys"))


def heading_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents' lines, each once a document, by how many documents have them; those of at least three."""
    heads = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\n")).alias("line")).select("doc_id", F.regexp_extract("line", r"^([A-Z][a-z]+)(?:[^A-Za-z]|$)", 1).alias("head")).where("head <> ''").distinct()
    return heads.groupBy("head").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


def headline_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same headline counts under two definitions of a case: customer, and customer with priority."""
    o = _orders(spark, d)
    out = None
    for name, key in (("customer", ["o_custkey"]), ("customer and priority", ["o_custkey", "o_orderpriority"])):
        g = o.groupBy(*key).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("v"))
        one = g.agg(F.lit(name).alias("definition"), F.count("*").alias("n_cases"), F.count_if(F.col("k") > 1).alias("n_repeated"), F.max("k").alias("largest"), F.avg("v").alias("mean_value"))
        out = one if out is None else out.unionByName(one)
    return out


def carried_dates(spark: SparkSession, d: str) -> DataFrame:
    """Events with the day of the last sign-up before them, those before any taking the first one's; whether most of a user's days are Thursdays."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.when(F.col("event_type") == "signup", F.to_date("ts"))
    carried = F.coalesce(F.last(day, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.first(day, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    out = e.withColumn("day", carried).groupBy("user_id").agg(F.count("*").alias("n"), F.count("day").alias("n_dated"), F.countDistinct("day").alias("n_days"), F.avg((F.dayofweek("day") == 5).cast("double")).alias("thursdays"))
    return out.withColumn("regular", F.coalesce(F.col("thursdays") >= 0.5, F.lit(False)))


def longest_block_per_case(spark: SparkSession, d: str) -> DataFrame:
    """The longest text of each source and language paired with its labels: matched, and unmatched either way."""
    docs = table(spark, d, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))
    l = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("labelled"))
    both = docs.withColumn("block", F.lit(1)).join(l, "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("block").isNotNull() & F.col("labelled").isNotNull()).alias("matched"), F.count_if(F.col("labelled").isNull()).alias("block_only"), F.count_if(F.col("block").isNull()).alias("label_only"))


def adjudication_tally(spark: SparkSession, d: str) -> DataFrame:
    """One row for each field of a customer on which two readings disagree, verdicts of before kept; tallied by field and verdict."""
    c = table(spark, d, "customer").withColumn("seg2", F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment"))).withColumn("nat2", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    long = c.select("c_custkey", F.expr("stack(2, 'segment', c_mktsegment, seg2, 'nation', cast(c_nationkey as string), cast(nat2 as string)) as (field, a, b)")).where("a <> b")
    ruled = c.where("c_custkey % 35 = 0").select("c_custkey", F.lit("segment").alias("field"), F.lit("first").alias("verdict"))
    return long.join(ruled, ["c_custkey", "field"], "left").groupBy("field", F.coalesce("verdict", F.lit("open")).alias("verdict")).agg(F.count("*").alias("n"))


def disagreement_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Who is right where two predictions and the gold label differ: both, first, second or neither, by language."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source"), "doc_id")
    a, b, g = (F.col("n_chars") > 600).cast("int"), (F.col("source") > "src5").cast("int"), F.col("quality")
    who = F.when((a == g) & (b == g), "both").when(a == g, "first").when(b == g, "second").otherwise("neither")
    return l.where("quality is not null").groupBy("lang", who.alias("right_one")).agg(F.count("*").alias("n"))


def migrated_instruments(spark: SparkSession, d: str) -> DataFrame:
    """A printed instrument split in kind and number where it is unambiguous, else flagged with a proposal."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Motion No. "), k)).when(k % 4 == 1, F.concat(F.lit("Resolution "), k)).when(k % 4 == 2, F.concat(F.lit("Motion/Resolution "), k)).otherwise(F.lit(None))
    motion, resolution = F.coalesce(text.contains("Motion"), F.lit(False)), F.coalesce(text.contains("Resolution"), F.lit(False))
    status = F.when(text.isNull(), "blank").when(motion != resolution, "derived").otherwise("flagged")
    kind = F.when(motion, "motion").when(resolution, "resolution")
    m = table(spark, d, "customer").select(status.alias("status"), kind.alias("kind"), F.regexp_extract(text, r"(\d+)", 1).try_cast("int").alias("no"))
    return m.groupBy("status", "kind").agg(F.count("*").alias("n"), F.max("no").alias("largest_no"))


def rates_over_agencies(spark: SparkSession, d: str) -> DataFrame:
    """Offences summed over a nation's suppliers, the largest population of each, and the rate per 100,000 of the region."""
    l = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("offences"), F.max("l_quantity").alias("population"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    a = l.groupBy("l_suppkey").agg(F.sum("offences").alias("offences"), F.max("population").alias("population"))
    out = a.join(s, "l_suppkey").join(table(spark, d, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.sum("offences").alias("offences"), F.sum("population").alias("population"))
    return out.withColumn("rate", 100000 * F.col("offences") / F.nullif("population", F.lit(0.0)))


def area_value_frame(spark: SparkSession, d: str) -> DataFrame:
    """Nations with what four tables say of them, joined outer: customers' mean balance, suppliers' median, orders of high value, and their ratio where the base is positive."""
    c = table(spark, d, "customer")
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("mean_customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.median(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))).alias("median_supplier"))
    o = _orders(spark, d).where("o_totalprice > 300000").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey").groupBy("k").agg(F.count("*").alias("n_dear"))
    out = a.join(b, "k", "full_outer").join(o, "k", "full_outer")
    return out.withColumn("ratio", F.when(F.col("median_supplier") > 0, F.col("mean_customer") / F.col("median_supplier")))


def later_permits_at_parcel(spark: SparkSession, d: str) -> DataFrame:
    """What follows at a part after its first urgent line: how many lines, the first lag and whether any is returned."""
    l = table(spark, d, "lineitem").join(_orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    first = l.where("o_orderpriority = '1-URGENT'").groupBy("l_partkey").agg(F.min("l_shipdate").alias("heard"))
    later = l.join(first, "l_partkey").where("l_shipdate > heard")
    return later.groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(F.datediff("l_shipdate", "heard")).alias("first_lag"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


def earliest_per_endpoint(spark: SparkSession, d: str) -> DataFrame:
    """Depth of each host's archive: the first page, whether it is full, partial or thin by its pages, and the months it spans."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), "page_id")
    g = p.groupBy("host").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"), F.countDistinct(F.floor(F.col("page_id") / 25)).alias("spans"))
    return g.withColumn("depth", F.when(F.col("n") >= 20, "full").when(F.col("n") >= 5, "partial").otherwise("thin"))


def tracks_and_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Three tracks of orders, contested (with a returned line), discretionary (urgent or high) and ministerial, with their clocks and negative spans apart."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("contested", F.lit(True))
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    o = _orders(spark, d).join(back, "o_orderkey", "left").join(last, "o_orderkey").withColumn("days", F.datediff("ship", "o_orderdate"))
    track = F.when(F.col("contested"), "contested").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "discretionary").otherwise("ministerial")
    return o.groupBy(track.alias("track")).agg(F.count("*").alias("n"), F.count_if(F.col("days") < 0).alias("n_negative"), F.median(F.when(F.col("days") >= 0, F.col("days"))).alias("median_days"), F.avg(F.when(F.col("days") >= 0, F.col("days"))).alias("mean_days"))


def case_clocks(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer and year: first and last order, the principal order by status, price and day, its share of the value, and the days between."""
    o = _orders(spark, d)
    g = o.groupBy("o_custkey", "year").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("n"), F.sum("o_totalprice").alias("v"), F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_orderstatus") == "F", "o_totalprice", -F.col("o_orderkey"))).alias("p"))
    return g.select("o_custkey", "year", "n", F.datediff("b", "a").alias("days"), F.col("p.o_orderkey").alias("principal"), (F.col("p.o_totalprice") / F.col("v")).alias("share"))


QUERIES = {f.__name__: f for f in (class_at_filing, text_reach, discovered_links, pull_targets, modal_type_per_case, residual_reasons, heading_document_frequency, headline_by_two_keys, carried_dates, longest_block_per_case, adjudication_tally, disagreement_attribution, migrated_instruments, rates_over_agencies, area_value_frame, later_permits_at_parcel, earliest_per_endpoint, tracks_and_clocks, case_clocks)}

ORACLE_SQL = {
    "class_at_filing": """
        WITH c AS (SELECT o_custkey, year(o_orderdate) AS y, arg_min(o_orderstatus, o_orderkey) AS cls FROM orders GROUP BY 1, 2), l AS (SELECT year(l_shipdate)::INT AS filed, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT filed, cls, count(*) AS n FROM l LEFT JOIN c ON c.o_custkey = l.o_custkey AND filed >= 1996 AND y = least(filed, 1999) GROUP BY 1, 2""",
    "text_reach": """
        WITH o AS (SELECT *, o_orderdate::DATE AS day FROM orders), x AS (SELECT * FROM o WHERE o_totalprice > 400000),
        h AS (SELECT year(o_orderdate)::INT AS year, o_custkey IN (SELECT o_custkey FROM x) AS a, EXISTS (SELECT 1 FROM x WHERE x.o_orderpriority = o.o_orderpriority AND x.day = o.day) AS b FROM o)
        SELECT year, count(*) AS n, count(*) FILTER (a) AS by_case, count(*) FILTER (b) AS by_motion, count(*) FILTER (a OR b) AS reached FROM h GROUP BY 1""",
    "discovered_links": r"""
        WITH e AS (SELECT url, 0 AS r FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), 1 FROM pages UNION ALL SELECT regexp_replace(url, '/[^/]*$', '/'), 2 FROM pages UNION ALL SELECT regexp_replace(url, '^http://', 'https://'), 3 FROM pages),
        f AS (SELECT url, min(r) AS r FROM e GROUP BY 1) SELECT ['self', 'anchor', 'upper', 'secure'][r + 1] AS source, count(*) AS n, count(*) FILTER (regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) <> '') AS n_keyed FROM f GROUP BY 1""",
    "pull_targets": """
        WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, length(html) < 400 AS failed FROM pages),
        t AS (SELECT * FROM p WHERE page_id % 3 <> 0 OR failed QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY page_id) = 1),
        r AS (SELECT t.*, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END, page_id) AS r FROM t LEFT JOIN labels ON doc_id = page_id)
        SELECT host, count(*) AS n, count(*) FILTER (failed) AS n_archive, min(page_id) FILTER (r = 1) AS first_page FROM r GROUP BY 1""",
    "modal_type_per_case": """
        WITH c AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2),
        k AS (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1)
        SELECT p AS modal, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, sum(l_quantity) AS quantity FROM lineitem JOIN k ON o_orderkey = l_orderkey JOIN c ON c.o_custkey = k.o_custkey AND r = 1 GROUP BY 1""",
    "residual_reasons": """
        WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN year(o_orderdate) >= 2000 THEN 'young' WHEN o_totalprice < 50000 THEN 'small' ELSE 'other' END AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
        SELECT reason, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS first_keys FROM r GROUP BY 1""",
    "heading_document_frequency": r"""
        WITH l AS (SELECT DISTINCT doc_id, regexp_extract(unnest(string_split(text, chr(10))), '^([A-Z][a-z]+)(?:[^A-Za-z]|$)', 1) AS head FROM documents) SELECT head, count(*) AS n_docs FROM l WHERE head <> '' GROUP BY 1 HAVING count(*) >= 3""",
    "headline_by_two_keys": """
        WITH a AS (SELECT count(*) AS k, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey), b AS (SELECT count(*) AS k, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey, o_orderpriority)
        SELECT 'customer' AS definition, count(*) AS n_cases, count(*) FILTER (k > 1) AS n_repeated, max(k) AS largest, avg(v) AS mean_value FROM a UNION ALL SELECT 'customer and priority', count(*), count(*) FILTER (k > 1), max(k), avg(v) FROM b""",
    "carried_dates": """
        WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN ts::DATE END AS s FROM events),
        c AS (SELECT user_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS day FROM e),
        g AS (SELECT user_id, count(*) AS n, count(day) AS n_dated, count(DISTINCT day) AS n_days, avg((dayofweek(day) = 4)::INT) AS thursdays FROM c GROUP BY 1) SELECT *, coalesce(thursdays >= 0.5, FALSE) AS regular FROM g""",
    "longest_block_per_case": """
        WITH b AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) = 1), l AS (SELECT doc_id FROM labels WHERE quality = 1)
        SELECT (SELECT count(*) FROM b JOIN l USING (doc_id)) AS matched, (SELECT count(*) FROM b ANTI JOIN l USING (doc_id)) AS block_only, (SELECT count(*) FROM l ANTI JOIN b USING (doc_id)) AS label_only""",
    "adjudication_tally": """
        SELECT 'segment' AS field, CASE WHEN c_custkey % 35 = 0 THEN 'first' ELSE 'open' END AS verdict, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 GROUP BY 2 UNION ALL SELECT 'nation', 'open', count(*) FROM customer WHERE c_custkey % 5 = 0""",
    "disagreement_attribution": """
        WITH l AS (SELECT lang, (n_chars > 600)::INT = quality AS a, (source > 'src5')::INT = quality AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
        SELECT lang, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'neither' END AS right_one, count(*) AS n FROM l GROUP BY 1, 2""",
    "migrated_instruments": """
        SELECT CASE c_custkey % 4 WHEN 0 THEN 'derived' WHEN 1 THEN 'derived' WHEN 2 THEN 'flagged' ELSE 'blank' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'motion' WHEN 1 THEN 'resolution' WHEN 2 THEN 'motion' END AS kind, count(*) AS n,
               max(CASE WHEN c_custkey % 4 < 3 THEN c_custkey END)::INT AS largest_no FROM customer GROUP BY 1, 2""",
    "rates_over_agencies": """
        WITH a AS (SELECT l_suppkey, count(*) AS o, max(l_quantity) AS p FROM lineitem GROUP BY 1) SELECT n_regionkey, sum(o)::BIGINT AS offences, sum(p) AS population, 100000 * sum(o) / nullif(sum(p), 0) AS rate FROM a JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
    "area_value_frame": """
        WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS mean_customer FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, median(s_acctbal) FILTER (s_acctbal > 0) AS median_supplier FROM supplier GROUP BY 1),
        o AS (SELECT c_nationkey AS k, count(*) AS n_dear FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY 1)
        SELECT k, mean_customer, median_supplier, n_dear, CASE WHEN median_supplier > 0 THEN mean_customer / median_supplier END AS ratio FROM a FULL JOIN b USING (k) FULL JOIN o USING (k)""",
    "later_permits_at_parcel": """
        WITH l AS (SELECT lineitem.*, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT l_partkey, min(l_shipdate) AS h FROM l WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
        SELECT l.l_partkey, count(*) AS n, min(l_shipdate::DATE - h::DATE)::INT AS first_lag, bool_or(l_returnflag = 'R') AS returned FROM l JOIN f ON f.l_partkey = l.l_partkey AND l_shipdate > h GROUP BY 1""",
    "earliest_per_endpoint": """
        WITH g AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(page_id) AS first_page, count(*) AS n, count(DISTINCT page_id // 25) AS spans FROM pages GROUP BY 1) SELECT *, CASE WHEN n >= 20 THEN 'full' WHEN n >= 5 THEN 'partial' ELSE 'thin' END AS depth FROM g""",
    "tracks_and_clocks": """
        WITH o AS (SELECT o_orderkey, o_orderpriority, max(l_shipdate)::DATE - any_value(o_orderdate)::DATE AS days, bool_or(l_returnflag = 'R') AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT CASE WHEN c THEN 'contested' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'discretionary' ELSE 'ministerial' END AS track, count(*) AS n, count(*) FILTER (days < 0) AS n_negative, median(days) FILTER (days >= 0) AS median_days, avg(days) FILTER (days >= 0) AS mean_days FROM o GROUP BY 1""",
    "case_clocks": """
        WITH o AS (SELECT *, year(o_orderdate)::INT AS year FROM orders), p AS (SELECT o_custkey, year, o_orderkey, o_totalprice FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, year ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) = 1)
        SELECT o.o_custkey, o.year, count(*) AS n, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS days, any_value(p.o_orderkey) AS principal, any_value(p.o_totalprice) / sum(o.o_totalprice) AS share FROM o JOIN p ON p.o_custkey = o.o_custkey AND p.year = o.year GROUP BY 1, 2""",
}
