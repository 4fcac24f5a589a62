"""Estimates and their evaluation: forecasts, calibration, comparators, boundary scores, sentinels, audits, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators import evaluation as E
from panelspark.operators import joins as J
from panelspark.operators import models as M
from panelspark.operators import quantiles as Q
from panelspark.operators import windows as R
from panelspark.session import table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases: days from order to its last shipment, clipped at 0, with the logarithm and two tails."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, d, "orders").join(l, "o_orderkey").withColumn("days", F.greatest(F.datediff("ship", "o_orderdate"), F.lit(0)))
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus", "quantity", "days", F.log1p("days").alias("ly"), (F.col("days") > 180).cast("double").alias("d180"), (F.col("days") > 365).cast("double").alias("d365"))


def out_of_sample(spark: SparkSession, d: str) -> DataFrame:
    """Cases to 1998 forecast the later ones by cells of priority and status: R2 within and outside, for the logarithm and, clipped to 0..1, for both tails; urgent cases of status P are unseen in training."""
    c = _cases(spark, d)
    train = c.where("year <= 1998 and not (o_orderpriority = '1-URGENT' and o_orderstatus = 'P')")
    test = c.where("year > 1998")
    out = None
    for y in ("ly", "d180", "d365"):
        one = E.cell_forecast(train, test, ["o_orderpriority", "o_orderstatus"], y, None if y == "ly" else (0.0, 1.0)).withColumn("outcome", F.lit(y))
        out = one if out is None else out.unionByName(one)
    return out


def calibration_deciles(spark: SparkSession, d: str) -> DataFrame:
    """What happened to each tenth of cases by fitted delay, the mean of a case's year, priority and status: equal edges are one."""
    c = _cases(spark, d)
    fit = c.groupBy("year", "o_orderpriority", "o_orderstatus").agg(F.avg("ly").alias("fit"))
    fitted = c.join(fit, ["year", "o_orderpriority", "o_orderstatus"]).withColumn("fit", F.round("fit", 9))
    b = Q.bins_by_edges(fitted, "fit", 10, "decile")
    return b.groupBy("decile").agg(F.count("*").alias("n"), F.expm1(F.avg("fit")).alias("predicted"), F.median("days").alias("median_days"), F.percentile("days", 0.75).alias("p75"), F.percentile("days", 0.9).alias("p90"), F.avg("d180").alias("over180"), F.avg("d365").alias("over365"))


def least_squares_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Least squares of the log delay on more and more covariates: quantity, then year, then an urgent flag and its product with quantity: n, R2, adjusted R2 and residual deviation by degrees of freedom."""
    c = _cases(spark, d).withColumn("y", (F.col("year") - 1998).cast("double")).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double")).withColumn("both", F.col("urgent") * F.col("quantity"))
    rows = []
    for step, xs in enumerate((["quantity"], ["quantity", "y"], ["quantity", "y", "urgent", "both"])):
        beta, fit = E.least_squares(c, "ly", xs)
        rows.append((step, fit["n"], fit["r2"], fit["r2_adj"], fit["sd"], beta[1]))
    return spark.createDataFrame(rows, "step int, n long, r2 double, r2_adj double, sd double, b_quantity double")


def field_comparators(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against gold by the comparator of each kind of field: how many customers agree under each."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    pairs = [
        ("enum", F.concat(F.lit(" "), F.lower("c_mktsegment")), F.when(k % 3 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))),
        ("identifier", F.regexp_replace("c_name", "#", "-"), F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name"))),
        ("date", F.lit("March 5, 1999"), F.when(k % 5 == 0, F.lit("1999-03-05")).when(k % 5 == 1, F.lit("3/5/99")).otherwise(F.lit("3/6/99"))),
        ("digits", F.concat(F.lit("lots 7, "), k.cast("string")), F.concat(k.cast("string"), F.when(k % 2 == 0, F.lit("/7")).otherwise(F.lit("/8")))),
        ("names", F.lit("Mr. John Lee, Ann Wu"), F.when(k % 2 == 0, F.lit("Wu; Lee")).otherwise(F.lit("Wu; Li"))),
        ("text", F.concat_ws(" ", F.lit("the new building at"), "c_name"), F.when(k % 3 == 0, F.lit("new building at")).when(k % 3 == 1, F.lit("a")).otherwise(F.lit("zzz"))),
    ]
    out = c.select(*[E.same_field(kind, p, g).alias(kind) for kind, p, g in pairs]).unpivot([], [kind for kind, _, _ in pairs], "kind", "same")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Days found for a user against the true ones, as sets: clicks' days against errors' days; precision, recall, and the means over users."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    s = E.set_scores(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], ["day"])
    return s.agg(F.count("*").alias("n_users"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.sum("n_both").alias("n_both"), F.sum("n_gold").alias("n_gold"))


def merge_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Signs that a text swallowed what follows it, by language: the next number with a name, an address of a letter, a licence line before its end; and the documents with any."""
    t = F.col("text")
    signs = {"next_number": t.rlike(r"(?:^|[.;:] )\d{1,2}\s?\. [A-Z][a-z]+"), "letter": t.rlike(r"(?i)(?:^|\s)dear\s+(?:sir|madam|mr|mrs)") | t.rlike(r"(?:^|\. )Re: "), "licence_inside": t.rlike(r"(?i)licensed under [^\n]+\n.*\S")}
    docs = table(spark, d, "documents").select("lang", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in signs.items()])
    return docs.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in signs], F.count_if(F.col("next_number") | F.col("letter") | F.col("licence_inside")).alias("any_sign"))


def label_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels against what their source says: a list of checks with severities for each, counted."""
    l = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    checks = E.issues(
        ("quality_of_short", "high", (F.col("quality") == 1) & (F.col("n_chars") < 300)),
        ("toxic_clean_source", "med", (F.col("toxic") == 1) & F.col("source").isin("src0", "src1")),
        ("length_mismatch", "low", F.col("n_chars") != F.length("text")),
    )
    i = l.select("doc_id", F.explode(checks).alias("i")).select("doc_id", "i.*")
    return i.groupBy("check", "severity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def additive_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Blank or `other` labels filled from the source record and never others: market segments by what the customer's key implies."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    label = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("Other")).when(k % 4 == 2, F.lit(None)).otherwise(F.col("c_mktsegment"))
    derived = F.when(k % 3 != 0, F.concat(F.lit("seg"), (k % 2).cast("string")))
    return c.groupBy(E.backfilled(label, derived).alias("segment")).agg(F.count("*").alias("n"))


def coverage_of_fields(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows with a value for each field, distinct values, and agreement with the gold field, by batch of customers."""
    c = table(spark, d, "customer").withColumn("batch", F.floor(F.col("c_custkey") / 50)).withColumn("seg", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment"))).withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")))
    long = c.select("batch", F.expr("stack(2, 'segment', seg, c_mktsegment, 'balance', bal, cast(c_acctbal as string)) as (field, value, gold)"))
    out = long.groupBy("batch", "field").agg(F.count("*").alias("n"), F.count("value").alias("n_filled"), F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("value") == F.col("gold")).alias("n_right"))
    run = W.partitionBy("field").orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn("running_accuracy", F.sum("n_right").over(run) / F.sum("n").over(run))


def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the mean as a forecast at three sizes over five seeds: mean and population deviation by size."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    seeds = F.explode(F.array(*[F.lit(s) for s in (1, 2, 3, 4, 5)])).alias("seed")
    shuffled = c.select("*", seeds).withColumn("k", F.pmod(F.col("c_custkey") * F.lit(7919) * F.col("seed") + F.col("seed") * 104729, F.lit(1000003)))
    placed = shuffled.withColumn("place", F.row_number().over(W.partitionBy("seed").orderBy("k", "c_custkey")))
    sized = placed.withColumn("size", F.explode(F.array(*[F.lit(s) for s in (10, 30, 90)]))).where("place <= size")
    means = sized.groupBy("size", "seed").agg(F.avg("c_acctbal").alias("m"))
    return means.groupBy("size").agg(F.count("*").alias("n_seeds"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))


def drawn_lags(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders' waits drawn for the others of their year and status, by place: the pool is a numbered table, so a draw is a join."""
    c = _cases(spark, d)
    pool = c.where("o_orderpriority = '1-URGENT'").withColumn("place", F.row_number().over(W.partitionBy("year", "o_orderstatus").orderBy("days", "o_orderkey")) - 1)
    size = pool.groupBy("year", "o_orderstatus").agg(F.count("*").alias("size"))
    rest = c.where("o_orderpriority <> '1-URGENT'").join(size, ["year", "o_orderstatus"]).withColumn("place", F.pmod(F.col("o_orderkey") * 7919, F.col("size")))
    drawn = rest.join(pool.select("year", "o_orderstatus", "place", F.col("days").alias("drawn")), ["year", "o_orderstatus", "place"])
    return drawn.groupBy("year").agg(F.count("*").alias("n"), F.avg("drawn").alias("mean_drawn"), F.median("drawn").alias("median_drawn"), F.avg("days").alias("mean_own"))


def rolling_mode_terms(spark: SparkSession, d: str) -> DataFrame:
    """Who presides: the most frequent priority among seven orders either way of each of a customer's orders, the first seen of ties, and its runs."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    smooth = o.withColumn("mode", R.rolling_mode(F.col("o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 7, 7))
    runs = smooth.withColumn("run", R.island(["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("mode"))).groupBy("o_custkey", "run", "mode").agg(F.count("*").alias("n"))
    return runs.groupBy("mode").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_orders"), F.max("n").alias("longest"))


def absorbed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of event types over each user's history: rolling mode, runs, and runs shorter than three absorbed by the longer neighbour."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return R.terms(e, "user_id", ["ts", "event_id"], "event_type", "ts", 3, 3)


def ordinal_under_header(spark: SparkSession, d: str) -> DataFrame:
    """Each event's last sign-up before it and its place under that header: how many lie under the n-th header, and before any."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = e.withColumn("header", F.count_if(F.col("event_type") == "signup").over(w))
    placed = h.withColumn("ordinal", F.row_number().over(W.partitionBy("user_id", "header").orderBy("ts", "event_id")))
    return placed.groupBy("header").agg(F.count("*").alias("n"), F.max("ordinal").alias("longest"), F.countDistinct("user_id").alias("n_users"))


def nearest_to_median(spark: SparkSession, d: str) -> DataFrame:
    """The record nearest its group's median: parts of each type by price, ties by key."""
    p = table(spark, d, "part")
    m = p.groupBy("p_type").agg(F.median("p_retailprice").alias("m"))
    return p.join(m, "p_type").groupBy("p_type").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_retailprice") - F.col("m")), "p_partkey")).alias("p_partkey"), F.first("m").alias("median_price"))


def rounds_compared(spark: SparkSession, d: str) -> DataFrame:
    """The same measures on two versions of a table, over the customers that both have: orders before and from 1998 on."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.when(F.year("o_orderdate") < 1998, "early").otherwise("late").alias("version"))
    both = o.groupBy("o_custkey").agg(F.countDistinct("version").alias("k")).where("k = 2").select("o_custkey")
    return o.join(both, "o_custkey", "left_semi").groupBy("version").agg(F.countDistinct("o_custkey").alias("n_customers"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"), F.median("o_totalprice").alias("median_price"))


def shares_about_the_mode(spark: SparkSession, d: str) -> DataFrame:
    """Shares of lines under, at and over the most frequent quantity, by ship year; equal lines of an order count once."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.year("l_shipdate").alias("year")).distinct()
    mode = J.modal(l.withColumn("one", F.lit(1)), ["one"], "l_quantity", "mode").select("mode")
    out = l.crossJoin(F.broadcast(mode)).groupBy("year")
    share = lambda c: F.avg(c.cast("double"))
    return out.agg(F.count("*").alias("n"), share(F.col("l_quantity") < F.col("mode")).alias("under"), share(F.col("l_quantity") == F.col("mode")).alias("at"), share(F.col("l_quantity") > F.col("mode")).alias("over"))


def measures_report(spark: SparkSession, d: str) -> DataFrame:
    """Each typed measure of a line: n, years spanned, median and p90, distinct values, the most common one and its share."""
    l = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    long = l.unpivot(["year"], ["l_quantity", "l_discount", "l_tax"], "measure", "value").where("value is not null")
    counts = long.groupBy("measure", "value").agg(F.count("*").alias("k"), F.min("year").alias("a"), F.max("year").alias("b"))
    top = counts.groupBy("measure").agg(F.sum("k").alias("n"), F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.count("*").alias("n_distinct"), F.min_by("value", F.struct(-F.col("k"), "value")).alias("most_common"), F.max("k").alias("k"), F.percentile("value", 0.5, F.col("k")).alias("median"), F.percentile("value", 0.9, F.col("k")).alias("p90"))
    return top.withColumn("share", F.col("k") / F.col("n")).drop("k")


def upper_median_month(spark: SparkSession, d: str) -> DataFrame:
    """Of each year the month whose number of orders is the upper median of its months', else the nearest, the earliest of ties."""
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    mid = m.groupBy("year").agg(F.array_sort(F.collect_list("n")).alias("ns")).select("year", F.expr("ns[cast(floor(size(ns) / 2) as int)]").alias("middle"))
    return m.join(mid, "year").groupBy("year").agg(F.min_by(F.struct("month", "n"), F.struct(F.abs(F.col("n") - F.col("middle")), "month")).alias("b")).select("year", "b.*")


def clock_table(spark: SparkSession, d: str) -> DataFrame:
    """Days of cases by status and half-decade: n, median, p90 and the share of zero, cells of at least 20."""
    c = _cases(spark, d).withColumn("era", F.floor(F.col("year") / 5) * 5)
    return c.groupBy("o_orderstatus", "era").agg(F.count("*").alias("n"), F.median("days").alias("median_days"), F.percentile("days", 0.9).alias("p90_days"), F.avg((F.col("days") == 0).cast("double")).alias("zero_share")).where("n >= 20")


def outcome_chain(spark: SparkSession, d: str) -> DataFrame:
    """What became of cases by priority: finished, open and pending shares, weighted by quantity too, and finished within a year."""
    c = _cases(spark, d)
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    weighted = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("quantity")).otherwise(0.0)) / F.sum("quantity")
    return c.groupBy("o_orderpriority").agg(F.count("*").alias("n"), share("F").alias("finished"), share("O").alias("open"), share("P").alias("pending"), weighted("F").alias("finished_w"), F.avg(((F.col("o_orderstatus") == "F") & (F.col("days") <= 365)).cast("double")).alias("within_year"))


def selectivity_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Finished share by year and priority with margins, cells of at least 20."""
    from panelspark.operators import stats as S

    c = _cases(spark, d)
    return S.cut_moments(c, [["year", "o_orderpriority"], ["year"], ["o_orderpriority"], []], ["year", "o_orderpriority"], [F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished")]).where("n >= 20")


def hot_spots(spark: SparkSession, d: str) -> DataFrame:
    """The ten parts with most lines, with the orders and years they come in; ties to the smaller key."""
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), F.countDistinct(F.year("l_shipdate")).alias("n_years"))
    return l.orderBy(F.desc("n"), "l_partkey").limit(10)


def match_rates_by_form(spark: SparkSession, d: str) -> DataFrame:
    """Match rate of references to a sample of parts by form of the key and year, with the lag where they match."""
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    form = F.when(F.length(F.col("l_partkey").cast("string")) <= 2, "short").when(F.col("l_partkey") % 2 == 0, "even").otherwise("odd")
    known = table(spark, d, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("met"))
    m = l.withColumn("form", form).join(known, "l_partkey", "left")
    return m.groupBy("form", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg(F.col("met").isNotNull().cast("double")).alias("rate"), F.median(F.when(F.col("met"), F.datediff("l_shipdate", "o_orderdate"))).alias("median_lag"))


def date_range_by_source(spark: SparkSession, d: str) -> DataFrame:
    """First and last day of each source's own clock, and its rows."""
    parts = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
    out = None
    for name, clock in parts:
        one = table(spark, d, name).agg(F.lit(name).alias("source"), F.date_format(F.min(clock), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(clock), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (out_of_sample, calibration_deciles, least_squares_ladder, field_comparators, boundary_scores, merge_sentinels, label_audit, additive_backfill, coverage_of_fields, learning_curve, drawn_lags, rolling_mode_terms, absorbed_terms, ordinal_under_header, nearest_to_median, rounds_compared, shares_about_the_mode, measures_report, upper_median_month, clock_table, outcome_chain, selectivity_crosstab, hot_spots, match_rates_by_form, date_range_by_source)}

_CASES = """c AS (SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderpriority, o_orderstatus, q AS quantity, greatest(s::DATE - o_orderdate::DATE, 0) AS days, ln(1 + greatest(s::DATE - o_orderdate::DATE, 0)) AS ly
             FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

ORACLE_SQL = {
    "out_of_sample": f"""
        WITH {_CASES}, y AS (SELECT year, o_orderpriority AS p, o_orderstatus AS s, unnest([{{'o': 'ly', 'y': ly}}, {{'o': 'd180', 'y': (days > 180)::INT}}, {{'o': 'd365', 'y': (days > 365)::INT}}], recursive := true) FROM c),
        tr AS (SELECT * FROM y WHERE year <= 1998 AND NOT (p = '1-URGENT' AND s = 'P')), te AS (SELECT * FROM y WHERE year > 1998),
        m AS (SELECT o, p, s, avg(y) AS f FROM tr GROUP BY 1, 2, 3), g AS (SELECT o, avg(y) AS g FROM tr GROUP BY 1),
        a AS (SELECT o, count(*) AS n_train, 1 - sum((y - f) ** 2) / sum((y - g) ** 2) AS r2_in FROM tr JOIN m USING (o, p, s) JOIN g USING (o) GROUP BY 1),
        b AS (SELECT o, count(f) AS n_test, count(*) - count(f) AS n_dropped, 1 - sum((y - f) ** 2) / sum((y - g) ** 2) FILTER (f IS NOT NULL) AS r2_out, avg(y) FILTER (f IS NOT NULL) AS mean_out FROM te LEFT JOIN m USING (o, p, s) JOIN g USING (o) GROUP BY 1)
        SELECT a.o AS outcome, n_train, r2_in, n_test, n_dropped, r2_out, mean_out FROM a JOIN b USING (o)""",
    "calibration_deciles": f"""
        WITH {_CASES}, f AS (SELECT *, round(avg(ly) OVER (PARTITION BY year, o_orderpriority, o_orderstatus), 9) AS fit FROM c),
        e AS (SELECT list_distinct(quantile_cont(fit, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e, min(fit) AS lo, max(fit) AS hi FROM f),
        b AS (SELECT f.*, len(list_filter(e, lambda x: fit > x AND x > lo AND x < hi)) AS decile FROM f, e)
        SELECT decile, count(*) AS n, exp(avg(fit)) - 1 AS predicted, median(days) AS median_days, quantile_cont(days, 0.75) AS p75, quantile_cont(days, 0.9) AS p90, avg((days > 180)::INT) AS over180, avg((days > 365)::INT) AS over365 FROM b GROUP BY 1""",
    "field_comparators": """
        SELECT 'enum' AS kind, count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0) AS n_same FROM customer UNION ALL SELECT 'identifier', count(*), count(*) FILTER (c_custkey % 4 <> 0) FROM customer
        UNION ALL SELECT 'date', count(*), count(*) FILTER (c_custkey % 5 < 2) FROM customer UNION ALL SELECT 'digits', count(*), count(*) FILTER (c_custkey % 2 = 0 OR c_custkey = 7 AND FALSE) FROM customer
        UNION ALL SELECT 'names', count(*), count(*) FILTER (c_custkey % 2 = 0) FROM customer UNION ALL SELECT 'text', count(*), count(*) FILTER (c_custkey % 3 < 2) FROM customer""",
    "boundary_scores": """
        WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type AS t FROM events WHERE event_type IN ('click', 'error')),
        u AS (SELECT user_id, day, bool_or(t = 'click') AS p, bool_or(t = 'error') AS g FROM e GROUP BY 1, 2),
        s AS (SELECT user_id, count(*) FILTER (p) AS np, count(*) FILTER (g) AS ng, count(*) FILTER (p AND g) AS nb FROM u GROUP BY 1)
        SELECT count(*) AS n_users, avg(nb / nullif(np, 0)) AS precision, avg(nb / nullif(ng, 0)) AS recall, sum(nb)::BIGINT AS n_both, sum(ng)::BIGINT AS n_gold FROM s""",
    "merge_sentinels": r"""
        WITH s AS (SELECT lang, regexp_matches(text, '(?:^|[.;:] )\d{1,2}\s?\. [A-Z][a-z]+') AS a, regexp_matches(text, '(?i)(?:^|\s)dear\s+(?:sir|madam|mr|mrs)') OR regexp_matches(text, '(?:^|\. )Re: ') AS b,
                   regexp_matches(text, '(?i)licensed under [^\n]+\n.*\S') AS c FROM documents)
        SELECT lang, count(*) AS n, count(*) FILTER (a) AS next_number, count(*) FILTER (b) AS letter, count(*) FILTER (c) AS licence_inside, count(*) FILTER (a OR b OR c) AS any_sign FROM s GROUP BY 1""",
    "label_audit": """
        WITH l AS (SELECT * FROM labels JOIN documents USING (doc_id))
        SELECT 'quality_of_short' AS "check", 'high' AS severity, count(*) AS n, min(doc_id) AS first_doc FROM l WHERE quality = 1 AND n_chars < 300 HAVING count(*) > 0
        UNION ALL SELECT 'toxic_clean_source', 'med', count(*), min(doc_id) FROM l WHERE toxic = 1 AND source IN ('src0', 'src1') HAVING count(*) > 0
        UNION ALL SELECT 'length_mismatch', 'low', count(*), min(doc_id) FROM l WHERE n_chars <> length(text) HAVING count(*) > 0""",
    "additive_backfill": """
        WITH x AS (SELECT CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Other' WHEN 2 THEN NULL ELSE c_mktsegment END AS l, CASE WHEN c_custkey % 3 <> 0 THEN 'seg' || (c_custkey % 2) END AS d FROM customer)
        SELECT CASE WHEN (l IS NULL OR lower(l) IN ('', 'other')) AND d IS NOT NULL THEN d ELSE l END AS segment, count(*) AS n FROM x GROUP BY 1""",
    "coverage_of_fields": """
        WITH c AS (SELECT c_custkey // 50 AS batch, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, c_acctbal FROM customer),
        g AS (SELECT batch, 'segment' AS field, count(*) AS n, count(seg) AS n_filled, count(DISTINCT seg) AS n_distinct, count(seg) AS n_right FROM c GROUP BY 1 UNION ALL SELECT batch, 'balance', count(*), count(bal), count(DISTINCT bal), count(bal) FROM c GROUP BY 1)
        SELECT *, sum(n_right) OVER w / sum(n) OVER w AS running_accuracy FROM g WINDOW w AS (PARTITION BY field ORDER BY batch)""",
    "learning_curve": """
        WITH s AS (SELECT c_custkey, c_acctbal, seed, row_number() OVER (PARTITION BY seed ORDER BY (c_custkey * 7919 * seed + seed * 104729) % 1000003, c_custkey) AS place FROM customer, range(1, 6) r(seed)),
        m AS (SELECT size, seed, avg(c_acctbal) AS m FROM s, (VALUES (10), (30), (90)) v(size) WHERE place <= size GROUP BY 1, 2) SELECT size::INT AS size, count(*) AS n_seeds, avg(m) AS mean, stddev_pop(m) AS sd FROM m GROUP BY 1""",
    "drawn_lags": f"""
        WITH {_CASES}, p AS (SELECT year, o_orderstatus, days, row_number() OVER (PARTITION BY year, o_orderstatus ORDER BY days, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY year, o_orderstatus) AS size FROM c WHERE o_orderpriority = '1-URGENT')
        SELECT c.year, count(*) AS n, avg(p.days) AS mean_drawn, median(p.days) AS median_drawn, avg(c.days) AS mean_own FROM c JOIN p ON p.year = c.year AND p.o_orderstatus = c.o_orderstatus AND o_orderkey * 7919 % size = place WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""",
    "rolling_mode_terms": """
        WITH o AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
        k AS (SELECT a.o_custkey, a.i, b.p, count(*) AS n, min(b.i) AS f FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i BETWEEN a.i - 7 AND a.i + 7 GROUP BY 1, 2, 3),
        m AS (SELECT o_custkey, i, arg_max(p, n * 1000000 - f) AS mode FROM k GROUP BY 1, 2), r AS (SELECT *, CASE WHEN mode = lag(mode) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY i)),
        t AS (SELECT o_custkey, mode, sum(new) OVER (PARTITION BY o_custkey ORDER BY i) AS run FROM r), g AS (SELECT o_custkey, run, mode, count(*) AS n FROM t GROUP BY 1, 2, 3)
        SELECT mode, count(*) AS n_terms, sum(n)::BIGINT AS n_orders, max(n) AS longest FROM g GROUP BY 1""",
    "ordinal_under_header": """
        WITH h AS (SELECT user_id, ts, event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events),
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id, header ORDER BY ts, event_id) AS o FROM h) SELECT header, count(*) AS n, max(o)::INT AS longest, count(DISTINCT user_id) AS n_users FROM p GROUP BY 1""",
    "nearest_to_median": """
        WITH m AS (SELECT p_partkey, p_type, p_retailprice, median(p_retailprice) OVER (PARTITION BY p_type) AS m FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY abs(p_retailprice - m), p_partkey) AS r FROM m)
        SELECT p_type, p_partkey, m AS median_price FROM r WHERE r = 1""",
    "rounds_compared": """
        WITH o AS (SELECT o_custkey, o_totalprice, CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS version FROM orders)
        SELECT version, count(DISTINCT o_custkey) AS n_customers, count(*) AS n, avg(o_totalprice) AS mean_price, median(o_totalprice) AS median_price FROM o WHERE o_custkey IN (SELECT o_custkey FROM o WHERE version = 'early' INTERSECT SELECT o_custkey FROM o WHERE version = 'late') GROUP BY 1""",
    "shares_about_the_mode": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_quantity AS q, year(l_shipdate)::INT AS year FROM lineitem), m AS (SELECT q AS m FROM l GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)
        SELECT year, count(*) AS n, avg((q < m)::INT) AS under, avg((q = m)::INT) AS at, avg((q > m)::INT) AS over FROM l, m GROUP BY 1""",
    "measures_report": """
        WITH x AS (SELECT year(l_shipdate)::INT AS y, unnest([{'measure': 'l_quantity', 'v': l_quantity}, {'measure': 'l_discount', 'v': l_discount}, {'measure': 'l_tax', 'v': nullif(l_tax, 0)}], recursive := true) FROM lineitem), v AS (SELECT * FROM x WHERE v IS NOT NULL),
        k AS (SELECT measure, v, count(*) AS k, row_number() OVER (PARTITION BY measure ORDER BY count(*) DESC, v) AS r FROM v GROUP BY 1, 2), a AS (SELECT measure, count(*) AS n, min(y) AS first_year, max(y) AS last_year, count(DISTINCT v) AS n_distinct, median(v) AS median, quantile_cont(v, 0.9) AS p90 FROM v GROUP BY 1)
        SELECT a.*, k.v AS most_common, k.k / n AS share FROM a JOIN k ON k.measure = a.measure AND r = 1""",
    "upper_median_month": """
        WITH m AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT year, list_sort(list(n)) AS ns FROM m GROUP BY 1), r AS (SELECT m.*, row_number() OVER (PARTITION BY m.year ORDER BY abs(n - ns[len(ns) // 2 + 1]), month) AS r FROM m JOIN d ON d.year = m.year)
        SELECT year, month, n FROM r WHERE r = 1""",
    "clock_table": f"""
        WITH {_CASES} SELECT o_orderstatus, year // 5 * 5 AS era, count(*) AS n, median(days) AS median_days, quantile_cont(days, 0.9) AS p90_days, avg((days = 0)::INT) AS zero_share FROM c GROUP BY 1, 2 HAVING count(*) >= 20""",
    "outcome_chain": f"""
        WITH {_CASES} SELECT o_orderpriority, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS finished, avg((o_orderstatus = 'O')::INT) AS open, avg((o_orderstatus = 'P')::INT) AS pending,
        sum(CASE WHEN o_orderstatus = 'F' THEN quantity ELSE 0 END) / sum(quantity) AS finished_w, avg((o_orderstatus = 'F' AND days <= 365)::INT) AS within_year FROM c GROUP BY 1""",
    "selectivity_crosstab": f"""
        WITH {_CASES} SELECT coalesce(year::VARCHAR, 'all') AS year, coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS finished FROM c GROUP BY CUBE (year, o_orderpriority) HAVING count(*) >= 20""",
    "hot_spots": "SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT year(l_shipdate)) AS n_years FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10",
    "match_rates_by_form": """
        SELECT CASE WHEN length(l_partkey::VARCHAR) <= 2 THEN 'short' WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS form, year(o_orderdate)::INT AS year, count(*) AS n, avg((p_partkey IS NOT NULL)::INT) AS rate,
        median(l_shipdate::DATE - o_orderdate::DATE) FILTER (p_partkey IS NOT NULL) AS median_lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size % 3 <> 0 GROUP BY 1, 2""",
    "date_range_by_source": """
        SELECT 'orders' AS source, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM orders
        UNION ALL SELECT 'lineitem', strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d'), count(*) FROM lineitem UNION ALL SELECT 'events', strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d'), count(*) FROM events""",
}
