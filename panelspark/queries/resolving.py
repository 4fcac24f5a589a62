"""Resolvers and panels: tiered keys, in-force values, vintages, variants, candidate keys, set algebra and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators import evaluation as E
from panelspark.operators import joins as J
from panelspark.operators import resolvers as R
from panelspark.session import table


def _day(c: str):
    return F.to_date(c)


def tiered_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Each line's order day resolved by (supplier, line number), else (supplier, month), else the only supplier row of its month: first rows win, the last tier needs one row. How many lines each tier resolves."""
    l = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    known = l.where("l_partkey % 97 = 0").withColumn("part", F.col("l_partkey"))
    tiers = [
        ("ordinal", R.first_of(known, ["l_suppkey", "l_linenumber"], ["month", "l_partkey"], "part"), ["l_suppkey", "l_linenumber"]),
        ("month", R.first_of(known, ["l_suppkey", "month"], ["l_linenumber", "l_partkey"], "part"), ["l_suppkey", "month"]),
        ("only", R.only_of(known, ["month"], "part"), ["month"]),
    ]
    out = J.cascade_join(l.where("l_partkey % 97 <> 0"), tiers, "part")
    return out.groupBy("how").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


def earliest_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Min-date form of the cascade: a customer's first urgent order, else the nation's, as a lag to each later one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("day"), "o_orderpriority")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    u = o.where("o_orderpriority = '1-URGENT'").join(c, "o_custkey")
    exact = u.groupBy("o_custkey").agg(F.min("day").alias("first"))
    general = u.groupBy("c_nationkey").agg(F.min("day").alias("first"))
    late = o.where("o_orderpriority = '5-LOW'").join(c, "o_custkey")
    out = R.fallback(late, exact, ["o_custkey"], general, ["c_nationkey"], "first")
    return out.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count("first").alias("n_known"), F.avg(F.datediff("day", "first")).alias("mean_lag"))


def in_force_class(spark: SparkSession, d: str) -> DataFrame:
    """Status of a customer's orders in each year of its panel: that of the year, else the first observed."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey", "o_orderstatus")
    own = R.first_of(o, ["o_custkey", "year"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    first = R.first_of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    spans = o.groupBy("o_custkey").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    panel = J.panel_years(spans, "a", "b").drop("a", "b")
    out = R.fallback(panel, own, ["o_custkey", "year"], first, ["o_custkey"], "o_orderstatus")
    return out.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"))


def zoning_vintages(spark: SparkSession, d: str) -> DataFrame:
    """Which vintage of a layer serves a ship year, and whether it is a snapshot of the current one."""
    served, snapshot = R.vintage(F.col("year"), [1995, 1996, 1998], 2020)
    l = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    return l.select("year", served.alias("vintage"), snapshot.alias("is_snapshot"), "n")


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Nations found by variants of a printed name: as it stands, without its last word, its first word; the earliest form that is known wins."""
    known = table(spark, d, "nation").select(F.upper("n_name").alias("variant"), "n_nationkey")
    said = table(spark, d, "customer").select("c_custkey", F.concat(F.element_at(F.array(F.lit("BRAZIL"), F.lit("CANADA CITY"), F.lit("UNITED KINGDOM TOWN OF"), F.lit("CHINA"), F.lit("ATLANTIS")), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("name"))
    words = F.split("name", " ")
    forms = [F.col("name"), F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")), F.when(F.size(words) > 1, words[0])]
    met = R.variants(said, "name", forms).join(F.broadcast(known), "variant")
    best = met.groupBy("c_custkey", "name").agg(F.min_by("n_nationkey", F.struct("place", "n_nationkey")).alias("n_nationkey"))
    return said.join(best, ["c_custkey", "name"], "left").groupBy("name", "n_nationkey").agg(F.count("*").alias("n"))


def best_score_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each urgent order's best supplier among those of its lines: a point a line, two for the same nation as the customer's; with the runner-up."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey")
    scored = pairs.groupBy("l_orderkey", "l_suppkey").agg((F.count("*") + F.max(F.when(F.col("s_nationkey") == F.col("c_nationkey"), 2).otherwise(0))).alias("score"))
    return R.best_with_margin(scored, "l_orderkey", "l_suppkey", "score")


def candidate_pairs_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier with every line number of an open order's lists, kept where such a line exists anywhere; how many of each order."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("block"), F.col("l_linenumber").alias("lot"))
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lists = l.join(o, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.collect_set("block").alias("blocks"), F.collect_set("lot").alias("lots"))
    made = lists.select("l_orderkey", F.explode(R.candidates_of(F.col("blocks"), F.col("lots"))).alias("c")).select("l_orderkey", "c.*")
    return made.join(l.select("block", "lot").distinct(), ["block", "lot"], "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def printed_percentage_check(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose discount is within a cent of one of four columns of their part, by brand."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", *[(F.pmod(F.col("p_partkey") * k, F.lit(11)) / 100).alias(f"c{k}") for k in (1, 3, 7)], F.lit(None).cast("double").alias("c9"))
    l = table(spark, d, "lineitem").select("l_partkey", "l_discount").join(p, "l_partkey")
    hit = R.any_within(F.col("l_discount"), [F.col(c) for c in ("c1", "c3", "c7", "c9")], 0.0001)
    return l.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_agree"))


def within_forty_lines(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a user with a purchase within two hours of it, either way: buckets of that width make it an equi join."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_timestamp("ts").alias("at"))
    w = 7200
    a = e.where("event_type = 'error'").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("at") / w) + k for k in (-1, 0, 1)])))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("other"), F.floor(F.col("at") / w).alias("bucket"))
    near = a.join(b, ["user_id", "bucket"]).where(F.abs(F.col("at") - F.col("other")) < w)
    return near.groupBy("user_id").agg(F.countDistinct("event_id").alias("n_errors"), F.count("*").alias("n_pairs"))


def sets_and_texts(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the set, the ordered list and the joined text of its priorities, and the union of the sets of its nation's."""
    o = table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("p")).alias("ps")).join(c, "o_custkey")
    return own.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))), ";").alias("all_p"), F.max(F.array_join("ps", "|")).alias("largest"), F.sum(F.size("ps")).alias("n_p"))


def weighted_means_of_columns(spark: SparkSession, d: str) -> DataFrame:
    """Means of three columns weighted by quantity within a supplier's nation, each over the rows where it is not null."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    l = table(spark, d, "lineitem").join(s, "l_suppkey").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    mean = lambda c: (F.sum(F.col(c) * F.col("l_quantity")) / F.sum(F.when(F.col(c).isNotNull(), F.col("l_quantity")))).alias(f"mean_{c}")
    return l.groupBy("s_nationkey").agg(mean("l_discount"), mean("l_tax"), mean("l_extendedprice"))


def dominant_share(spark: SparkSession, d: str) -> DataFrame:
    """Of each supplier the return flag that takes most quantity, its share of what is classified, and the share that is not (flag N)."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    named = F.col("l_returnflag") != "N"
    out = g.groupBy("l_suppkey").agg(F.max_by(F.when(named, F.col("l_returnflag")), F.when(named, F.struct("q", "l_returnflag"))).alias("dominant"), F.max(F.when(named, F.col("q"))).alias("q"), F.sum(F.when(named, F.col("q"))).alias("classified"), F.sum("q").alias("whole"))
    return out.select("l_suppkey", "dominant", (F.col("q") / F.col("classified")).alias("share"), (1 - F.col("classified") / F.col("whole")).alias("missing"))


def geometric_gap_year(spark: SparkSession, d: str) -> DataFrame:
    """Yearly order totals by status, 1998 left out and put back as the geometric mean of its neighbours."""
    y = table(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    gap = y.where("year in (1997, 1999)").groupBy("o_orderstatus").agg(F.lit(1998).alias("year"), F.sqrt(F.max(F.when(F.col("year") == 1997, F.col("total"))) * F.max(F.when(F.col("year") == 1999, F.col("total")))).alias("total"), F.lit(True).alias("interpolated"))
    return y.where("year <> 1998").withColumn("interpolated", F.lit(False)).unionByName(gap)


def counts_by_place_then_area(spark: SparkSession, d: str) -> DataFrame:
    """Partial then final: lines a supplier, then a nation, then a region, with the largest supplier of each."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(s, "l_suppkey").join(table(spark, d, "nation"), "n_nationkey")
    return by.groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.count("*").alias("n_suppliers"), F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("largest"))


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Customers with urgent and with low orders: both, only one, and whether the two sets are equal."""
    o = table(spark, d, "orders")
    a, b = (o.where(f"o_orderpriority = '{p}'").select("o_custkey") for p in ("1-URGENT", "5-LOW"))
    flags = a.distinct().withColumn("a", F.lit(1)).join(b.distinct().withColumn("b", F.lit(1)), "o_custkey", "full_outer")
    out = flags.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_urgent_only"), F.count_if(F.col("a").isNull()).alias("n_low_only"))
    return out.withColumn("equal", (F.col("n_urgent_only") + F.col("n_low_only")) == 0)


def sorted_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Places of customers by balance descending, negative ones as null and last, ties by key: the first of each nation."""
    c = table(spark, d, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    r = c.withColumn("place", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("balance"), "c_custkey")))
    return r.where("place <= 2 or balance is null").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.sum("balance").alias("top"))


def tri_state_flags(spark: SparkSession, d: str) -> DataFrame:
    """yes, no and unknown of a printed answer, by region."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.element_at(F.array(F.lit(" Yes "), F.lit("no"), F.lit("YES"), F.lit(None).cast("string"), F.lit("n/a")), (F.col("c_custkey") % 5 + 1).cast("int"))
    yes = F.coalesce(F.lower(F.trim(said)) == "yes", F.lit(False))
    return c.groupBy("n_regionkey").agg(F.count_if(yes).alias("n_yes"), F.count_if(~yes & F.coalesce(F.lower(F.trim(said)) == "no", F.lit(False))).alias("n_no"), F.count("*").alias("n"))


def arms_length_screen(spark: SparkSession, d: str) -> DataFrame:
    """Lines that pass a screen: none of three flags and at least 1,000, by year."""
    l = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    flagged = (F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.1) | (F.col("l_quantity") <= 2)
    kept = ~flagged & (F.col("l_extendedprice") >= 1000)
    return l.groupBy("year").agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"), F.avg(F.when(kept, F.col("l_extendedprice"))).alias("mean_price"))


def url_status_repair(spark: SparkSession, d: str) -> DataFrame:
    """Status of pages repaired by parts of their url and text: login, soft missing, error or fine, by host."""
    p = table(spark, d, "pages")
    host, path = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    status = F.when(path.rlike("(?i)login|signin"), "login").when(F.lower("html").contains("not found"), "soft_404").when(F.length("html") < 200, "error").otherwise("ok")
    return p.groupBy(host.alias("host"), status.alias("status")).agg(F.count("*").alias("n"))


def columns_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Means of the columns of lines that a pattern of names picks, geometry-like keys dropped."""
    l = table(spark, d, "lineitem")
    import re

    picked = [c for c in l.columns if re.search(r"(?:price|discount|tax|quantity)$", c)]
    long = l.select(*picked).unpivot([], picked, "column", "value")
    return long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def partitions_and_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Parts in an arithmetic order, in nested prefixes of 10, 20 and 40 that take one of each type in turn: classes of each prefix."""
    p = table(spark, d, "part").select("p_partkey", "p_type", (F.pmod(F.col("p_partkey") * 7919, F.lit(10007))).alias("k"))
    nested = E.nested_prefixes(p, "p_type", ["k", "p_partkey"], [10, 20, 40])
    return nested.groupBy("size", "p_type").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("parts"))


def label_deficits(spark: SparkSession, d: str) -> DataFrame:
    """How many labels each source lacks to a target of 25, and the rarity of the unlabelled documents: unseen sources want the whole target."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    short = E.deficits(labelled, "source", 25)
    rest = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").join(short, "source", "left")
    return rest.groupBy("source").agg(F.count("*").alias("n_waiting"), F.max(F.coalesce("deficit", F.lit(25))).alias("score"))


def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stores of one key merged in order of priority, the first that has it wins: finished before open before pending orders of a customer and year."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderkey")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = J.latest_wins(o, ["o_custkey", "year"], rank, F.col("o_orderkey"))
    return best.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Queue entries not there yet, keys compared null-safe: (user, type) pairs of late events against those of early ones."""
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user"), "event_type", "ts")
    old = e.where("ts < '2024-01-10'").select("user", "event_type").distinct().toDF("u", "t")
    new = e.where("ts >= '2024-01-10'").select("user", "event_type").distinct()
    added = new.join(old, F.col("user").eqNullSafe(F.col("u")) & (F.col("event_type") == F.col("t")), "left_anti")
    return added.groupBy("event_type").agg(F.count("*").alias("n"), F.count("user").alias("n_named"))


def runs_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each region with counts from three tables that hang on it: nations, customers and suppliers."""
    n = table(spark, d, "nation")
    per = n.select("n_regionkey", "n_nationkey")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    by = per.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").groupBy("n_regionkey").agg(F.count("*").alias("n_nations"), F.sum(F.coalesce("c", F.lit(0))).alias("n_customers"), F.sum(F.coalesce("s", F.lit(0))).alias("n_suppliers"))
    return table(spark, d, "region").join(by, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_nations", "n_customers", "n_suppliers")])


def searched_queue(spark: SparkSession, d: str) -> DataFrame:
    """A filtered list: parts whose name or type has a word, by priority of brand and price, the first 25."""
    p = table(spark, d, "part")
    hit = F.lower("p_name").contains("widget") & (F.col("p_size") >= 10)
    return p.where(hit).orderBy(F.desc(F.col("p_brand") == "Brand#5"), F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_brand", "p_retailprice")


def upsert_balances(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances with those of later answers put over them: the latest order's price of each, else the old one; by nation."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    new = J.latest_wins(o, ["c_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", F.col("o_totalprice").alias("new"))
    both = c.join(new, "c_custkey", "left")
    return both.groupBy("c_nationkey").agg(F.count("new").alias("n_replaced"), F.sum(F.coalesce("new", "c_acctbal")).alias("total"))


QUERIES = {f.__name__: f for f in (tiered_resolver, earliest_fallback, in_force_class, zoning_vintages, name_variants, best_score_assignment, candidate_pairs_kept, printed_percentage_check, within_forty_lines, sets_and_texts, weighted_means_of_columns, dominant_share, geometric_gap_year, counts_by_place_then_area, set_algebra, sorted_nulls_last, tri_state_flags, arms_length_screen, url_status_repair, columns_by_name, partitions_and_prefixes, label_deficits, priority_merge, insert_if_absent, runs_with_counts, searched_queue, upsert_balances)}

ORACLE_SQL = {
    "tiered_resolver": """
        WITH l AS (SELECT l_suppkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
        k AS (SELECT * FROM l WHERE l_partkey % 97 = 0),
        a AS (SELECT l_suppkey, l_linenumber, arg_min(l_partkey, month || lpad(l_partkey::VARCHAR, 12, '0')) AS p FROM k GROUP BY 1, 2),
        b AS (SELECT l_suppkey, month, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS p FROM k GROUP BY 1, 2),
        c AS (SELECT month, min(l_partkey) AS p FROM k GROUP BY 1 HAVING count(*) = 1),
        j AS (SELECT CASE WHEN a.p IS NOT NULL THEN 'ordinal' WHEN b.p IS NOT NULL THEN 'month' WHEN c.p IS NOT NULL THEN 'only' ELSE 'none' END AS how, coalesce(a.p, b.p, c.p) AS part
              FROM l LEFT JOIN a USING (l_suppkey, l_linenumber) LEFT JOIN b ON b.l_suppkey = l.l_suppkey AND b.month = l.month LEFT JOIN c ON c.month = l.month WHERE l_partkey % 97 <> 0)
        SELECT how, count(*) AS n, sum(part)::BIGINT AS parts FROM j GROUP BY how""",
    "earliest_fallback": """
        WITH o AS (SELECT o_custkey, o_orderdate::DATE AS day, o_orderpriority AS p, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
        e AS (SELECT o_custkey, min(day) AS f FROM o WHERE p = '1-URGENT' GROUP BY 1), g AS (SELECT c_nationkey, min(day) AS f FROM o WHERE p = '1-URGENT' GROUP BY 1)
        SELECT o.c_nationkey, count(*) AS n, count(coalesce(e.f, g.f)) AS n_known, avg(day - coalesce(e.f, g.f)) AS mean_lag
        FROM o LEFT JOIN e USING (o_custkey) LEFT JOIN g ON g.c_nationkey = o.c_nationkey WHERE p = '5-LOW' GROUP BY 1""",
    "in_force_class": """
        WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r0, o_orderstatus AS s FROM orders),
        sp AS (SELECT o_custkey, unnest(range(min(y), max(y) + 1)) AS y FROM o GROUP BY 1)
        SELECT sp.y::INT AS year, coalesce(a.s, f.s) AS o_orderstatus, count(*) AS n FROM sp LEFT JOIN o a ON a.o_custkey = sp.o_custkey AND a.y = sp.y AND a.r = 1 JOIN o f ON f.o_custkey = sp.o_custkey AND f.r0 = 1 GROUP BY ALL""",
    "zoning_vintages": """
        SELECT year(l_shipdate)::INT AS year, CASE WHEN year(l_shipdate) IN (1995, 1996, 1998) THEN year(l_shipdate) WHEN year(l_shipdate) > 1998 THEN 2020 END::INT AS vintage,
               year(l_shipdate) > 1998 AS is_snapshot, count(*) AS n FROM lineitem GROUP BY ALL""",
    "name_variants": """
        WITH s AS (SELECT c_custkey, ['BRAZIL', 'CANADA CITY', 'UNITED KINGDOM TOWN OF', 'CHINA', 'ATLANTIS'][c_custkey % 5 + 1] AS name FROM customer),
        w AS (SELECT *, string_split(name, ' ') AS w FROM s),
        v AS (SELECT c_custkey, name, unnest([{'p': 0, 'v': name}, {'p': 1, 'v': CASE WHEN len(w) > 1 THEN array_to_string(w[:-2], ' ') END}, {'p': 2, 'v': CASE WHEN len(w) > 1 THEN w[1] END}]) AS x FROM w),
        m AS (SELECT c_custkey, arg_min(n_nationkey, x.p) AS k FROM v JOIN nation ON upper(n_name) = x.v GROUP BY 1)
        SELECT name, k AS n_nationkey, count(*) AS n FROM s LEFT JOIN m USING (c_custkey) GROUP BY ALL""",
    "best_score_assignment": """
        WITH p AS (SELECT l_orderkey, l_suppkey, count(*) + max(CASE WHEN s_nationkey = c_nationkey THEN 2 ELSE 0 END) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT' JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey) AS r FROM p)
        SELECT a.l_orderkey, a.l_suppkey, a.score, b.score AS runner_up, a.score - coalesce(b.score, 0) AS margin FROM r a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.r = 2 WHERE a.r = 1""",
    "candidate_pairs_kept": """
        WITH l AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'P'),
        c AS (SELECT DISTINCT a.k, a.s, b.n FROM l a JOIN l b USING (k)) SELECT k AS l_orderkey, count(*) AS n FROM c WHERE (s, n) IN (SELECT (l_suppkey, l_linenumber) FROM lineitem) GROUP BY 1""",
    "printed_percentage_check": """
        SELECT p_brand, count(*) AS n, count(*) FILTER (abs(p_partkey % 11 / 100 - l_discount) <= 0.0001 OR abs(p_partkey * 3 % 11 / 100 - l_discount) <= 0.0001 OR abs(p_partkey * 7 % 11 / 100 - l_discount) <= 0.0001) AS n_agree
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "within_forty_lines": """
        SELECT a.user_id, count(DISTINCT a.event_id) AS n_errors, count(*) AS n_pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase'
        AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) < 7200 GROUP BY 1""",
    "sets_and_texts": """
        WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority[1])) AS ps FROM orders GROUP BY 1)
        SELECT c_nationkey, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(ps)))), ';') AS all_p, max(array_to_string(ps, '|')) AS largest, sum(len(ps))::BIGINT AS n_p FROM o JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "weighted_means_of_columns": """
        SELECT s_nationkey, sum(l_discount * l_quantity) / sum(l_quantity) AS mean_l_discount, sum(nullif(l_tax, 0) * l_quantity) / sum(l_quantity) FILTER (l_tax <> 0) AS mean_l_tax, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean_l_extendedprice
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "dominant_share": """
        WITH g AS (SELECT l_suppkey, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, sum(q) FILTER (f <> 'N') AS c, sum(q) AS w FROM g GROUP BY 1),
        m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, f DESC) AS r FROM g WHERE f <> 'N')
        SELECT t.l_suppkey, m.f AS dominant, m.q / c AS share, 1 - c / w AS missing FROM t LEFT JOIN m ON m.l_suppkey = t.l_suppkey AND r = 1""",
    "geometric_gap_year": """
        WITH y AS (SELECT o_orderstatus, year(o_orderdate)::INT AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
        SELECT *, FALSE AS interpolated FROM y WHERE year <> 1998 UNION ALL
        SELECT a.o_orderstatus, 1998, sqrt(a.total * b.total), TRUE FROM (SELECT * FROM y WHERE year = 1997) a FULL JOIN (SELECT * FROM y WHERE year = 1999) b USING (o_orderstatus)""",
    "counts_by_place_then_area": """
        WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT n_regionkey, sum(n)::BIGINT AS n, count(*) AS n_suppliers, arg_max(l_suppkey, n * 1000000 - l_suppkey) AS largest FROM s JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
    "set_algebra": """
        WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
        SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_urgent_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_low_only,
               NOT EXISTS (FROM a EXCEPT FROM b) AND NOT EXISTS (FROM b EXCEPT FROM a) AS equal""",
    "sorted_nulls_last": """
        WITH r AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal >= 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer)
        SELECT c_nationkey, count(*) AS n, max(place)::INT AS last, sum(b) AS top FROM r WHERE place <= 2 OR b IS NULL GROUP BY 1""",
    "tri_state_flags": """
        SELECT n_regionkey, count(*) FILTER (c_custkey % 5 IN (0, 2)) AS n_yes, count(*) FILTER (c_custkey % 5 = 1) AS n_no, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
    "arms_length_screen": """
        WITH l AS (SELECT year(l_shipdate)::INT AS year, l_extendedprice AS x, l_returnflag <> 'R' AND l_discount < 0.1 AND l_quantity > 2 AND l_extendedprice >= 1000 AS k FROM lineitem)
        SELECT year, count(*) AS n, count(*) FILTER (k) AS n_kept, avg(x) FILTER (k) AS mean_price FROM l GROUP BY 1""",
    "url_status_repair": r"""
        SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(?i)login|signin') THEN 'login' WHEN contains(lower(html), 'not found') THEN 'soft_404' WHEN length(html) < 200 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY ALL""",
    "columns_by_name": """
        SELECT 'l_quantity' AS column, count(l_quantity) AS n, avg(l_quantity) AS mean FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), avg(l_extendedprice) FROM lineitem
        UNION ALL SELECT 'l_discount', count(l_discount), avg(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), avg(l_tax) FROM lineitem""",
    "partitions_and_prefixes": """
        WITH p AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey * 7919 % 10007, p_partkey) AS t FROM part), o AS (SELECT *, row_number() OVER (ORDER BY t, p_type) AS place FROM p)
        SELECT s::INT AS size, p_type, count(*) AS n, sum(p_partkey)::BIGINT AS parts FROM o, (VALUES (10), (20), (40)) v(s) WHERE place <= s GROUP BY ALL""",
    "label_deficits": """
        WITH h AS (SELECT source, count(*) AS have FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
        SELECT source, count(*) AS n_waiting, max(CASE WHEN have IS NULL THEN 25 ELSE greatest(25 - have, 0) END)::BIGINT AS score FROM documents LEFT JOIN h USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
    "priority_merge": """
        WITH r AS (SELECT year(o_orderdate)::INT AS year, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders)
        SELECT year, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r WHERE r = 1 GROUP BY 1, 2""",
    "insert_if_absent": """
        WITH e AS (SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS u, event_type AS t, ts FROM events), n AS (SELECT u, t FROM e WHERE ts >= '2024-01-10' EXCEPT SELECT u, t FROM e WHERE ts < '2024-01-10')
        SELECT t AS event_type, count(*) AS n, count(u) AS n_named FROM n GROUP BY 1""",
    "runs_with_counts": """
        SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_nations, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS n_customers,
               (SELECT count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = r_regionkey) AS n_suppliers FROM region""",
    "searched_queue": """
        SELECT p_partkey, p_brand, p_retailprice FROM part WHERE lower(p_name) LIKE '%widget%' AND p_size >= 10 ORDER BY (p_brand = 'Brand#5') DESC, p_retailprice DESC, p_partkey LIMIT 25""",
    "upsert_balances": """
        WITH n AS (SELECT o_custkey, arg_max(o_totalprice, epoch(o_orderdate) * 10000000 + o_orderkey) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT c_nationkey, count(x) AS n_replaced, sum(coalesce(x, c_acctbal)) AS total FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY 1""",
}
