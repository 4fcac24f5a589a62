"""Distributions, pivots, margins, smoothing, reweighting, survival, sampling and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.operators import joins as J
from panelspark.operators import quantiles as Q
from panelspark.operators import stats as S
from panelspark.operators import survival as V
from panelspark.operators import windows as R
from panelspark.session import table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))


def chain_delay_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Days from a user's first to last event of each type: median and p90 by type, types of at least 20 users."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    out = e.groupBy("event_type").agg(F.count("*").alias("n_users"), F.median("days").alias("median_days"), F.percentile("days", 0.9).alias("p90_days"), F.avg((F.col("n") > 1).cast("double")).alias("multi_share"))
    return out.where("n_users >= 20")


def first_row_vs_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """The first row's value of each user, null where it is low, against the first value that is not null."""
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min_by("v", order).alias("first_row"), F.min_by("v", F.when(F.col("v").isNotNull(), order)).alias("first_non_null"), F.max_by("v", F.when(F.col("v").isNotNull(), order)).alias("last_non_null"))


def outcome_rates_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """Share of finished orders by year, and its mean over three rows centred."""
    y = _orders(spark, d).groupBy("year").agg(F.count("*").alias("n"), (100 * F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("rate"))
    return y.withColumn("smooth", R.rolling(F.col("rate"), [], ["year"], 1, 1))


def trailing4_min2(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly orders by status with the mean of the last four quarters, from two on; and the centred one of rows -2..+1."""
    q = _orders(spark, d).groupBy("o_orderstatus", F.date_trunc("quarter", "o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))
    return q.withColumn("trailing", R.rolling(F.col("n"), ["o_orderstatus"], ["quarter"], 3, 0, 2)).withColumn("centred", R.rolling(F.col("n"), ["o_orderstatus"], ["quarter"], 2, 1, 2))


def calendar_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """Daily event value by type with the mean over three days either way of the calendar."""
    day = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return day.withColumn("mean7", R.calendar_rolling(F.col("total"), ["event_type"], F.unix_date("day"), 3))


def composition_pivot_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of priorities among each year's orders."""
    p = _orders(spark, d).groupBy("year").pivot("o_orderpriority", list(PRIORITIES)).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in PRIORITIES), F.lit(0))
    return p.select("year", *[(F.col(f"`{c}`") / total).alias(f"share_{c[0]}") for c in PRIORITIES])


def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    """Line items by return flag and status, with totals of rows, columns and all."""
    return S.cut_moments(table(spark, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")])


def multi_cut_moments(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of order prices over all, by status, by priority and by both; cells of at least 20."""
    keys = ["o_orderstatus", "o_orderpriority"]
    m = S.cut_moments(_orders(spark, d), [keys, keys[:1], keys[1:], []], keys, S.moments(F.col("o_totalprice"))).where("n >= 20")
    cell = lambda *own: F.struct(*[(F.col(k) if k in own else F.lit("all")).alias(k) for k in keys])
    long = _orders(spark, d).select("o_totalprice", F.explode(F.array(cell(*keys), cell(keys[0]), cell(keys[1]), cell())).alias("c")).select("c.*", "o_totalprice")
    q = Q.quantile_table(long, keys, "o_totalprice", (0.1, 0.25, 0.5, 0.75, 0.9), ["p10", "p25", "p50", "p75", "p90"])
    return m.join(q.withColumn("iqr", F.col("p75") - F.col("p25")).drop("p25", "p75"), keys)


def within_year_quantile_universe(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the universe by any of three rules: dear for their year, urgent, or open; each rule counted."""
    o = _orders(spark, d)
    cut = Q.quantile_table(o, ["year"], "o_totalprice", (0.95,), ["cut"])
    r = o.join(cut, "year").select("year", (F.col("o_totalprice") >= F.col("cut")).alias("dear"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_orderstatus") == "O").alias("open"))
    return r.groupBy("year").agg(F.count_if("dear").alias("n_dear"), F.count_if("urgent").alias("n_urgent"), F.count_if("open").alias("n_open"), F.count_if(F.col("dear") | F.col("urgent") | F.col("open")).alias("n_any"))


def value_quintile_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Mean price of each year's quintiles, ties broken by key."""
    q = _orders(spark, d).withColumn("quintile", F.ntile(5).over(W.partitionBy("year").orderBy("o_totalprice", "o_orderkey")))
    return q.groupBy("year", "quintile").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))


def deciles_by_edges(spark: SparkSession, d: str) -> DataFrame:
    """Account balances in ten right-closed bins between their own deciles."""
    c = table(spark, d, "customer")
    edges = Q.exact_quantiles(c, [], "c_acctbal", tuple(i / 10 for i in range(11)))[()][1]
    b = c.withColumn("bin", R.quantile_bin(F.col("c_acctbal"), [F.lit(e) for e in edges]))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))


def weighted_mean_var(spark: SparkSession, d: str) -> DataFrame:
    mean, var = S.weighted(F.col("l_discount"), F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(mean.alias("w_mean"), var.alias("w_var"))


def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    """Median price of each return flag's lines, weighted by quantity: a step function."""
    return S.weighted_quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.5, "w_median")


def variance_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Share of the variance of prices that the year, and the year with priority, absorb."""
    o = _orders(spark, d).select("o_totalprice", "year", "o_orderpriority")
    x = F.col("o_totalprice")
    cell = o.groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    year = cell.groupBy("year").agg(F.sum("n").alias("yn"), F.sum("s").alias("ys"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum("q").alias("yq"))
    total = F.sum("yq") - F.sum("ys") * F.sum("ys") / F.sum("yn")
    return year.agg(((F.sum(F.col("ys") * F.col("ys") / F.col("yn")) - F.sum("ys") * F.sum("ys") / F.sum("yn")) / total).alias("share_year"), ((F.sum("within") - F.sum("ys") * F.sum("ys") / F.sum("yn")) / total).alias("share_both"))


def risk_set_funnel(spark: SparkSession, d: str) -> DataFrame:
    steps = [("all", F.lit(True)), ("dear", F.col("o_totalprice") > 100000), ("urgent or high", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), ("finished", F.col("o_orderstatus") == "F"), ("late years", F.col("year") >= 1998)]
    return S.funnel(_orders(spark, d), steps, "o_custkey")


def cell_reweight_stddiff(spark: SparkSession, d: str) -> DataFrame:
    """Prices of urgent and high orders against the rest, the rest weighted to the same nations and years."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = _orders(spark, d).join(c, "o_custkey").withColumn("treated", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return S.standardised_difference(S.reweight(o, "treated", ["c_nationkey", "year"]), "treated", "o_totalprice", "weight")


def _spells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    l = table(spark, d, "lineitem").join(o, "l_orderkey")
    days, _ = V.spell(F.col("o_orderdate"), F.col("l_shipdate"), F.col("l_shipdate"))
    return l.select("o_orderpriority", "l_returnflag", F.floor(days / 30).cast("int").alias("t"))


def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return V.kaplan_meier(_spells(spark, d), ["o_orderpriority"], "t", F.col("l_returnflag") != "R")


def km_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return V.km_quantiles(km_curve(spark, d), ["o_orderpriority"], "t", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def hazard_90d(spark: SparkSession, d: str) -> DataFrame:
    return V.hazard(_spells(spark, d), ["o_orderpriority"], "t", F.col("l_returnflag") != "R", 3, 60, 20)


def cif_curve(spark: SparkSession, d: str) -> DataFrame:
    return V.incidence(_spells(spark, d), ["o_orderpriority"], "t", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


def landmark_compare(spark: SparkSession, d: str) -> DataFrame:
    """Immortal-time-free comparison: users with an error get the next click after it as landmark, the rest a lag drawn from the errors' own by an arithmetic rule."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("error"))
    # The errors' lags as steps, one row a day of lag: a draw falls into the step that holds its place.
    steps = first.where("error is not null").groupBy(F.datediff("error", "start").alias("drawn")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.orderBy("drawn"))
    steps = steps.withColumn("high", upto).withColumn("low", upto - F.col("k")).withColumn("size", F.sum("k").over(W.partitionBy()))
    size = steps.agg(F.max("size").alias("size"))
    placed = first.crossJoin(F.broadcast(size)).withColumn("place", F.pmod("user_id", "size"))
    met = placed.join(F.broadcast(steps.select("drawn", "low", "high")), (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    drawn = met.withColumn("lag", F.when(F.col("error").isNotNull(), F.datediff("error", "start")).otherwise(F.col("drawn")))
    alive = drawn.where(F.datediff("end", "start") >= F.col("lag")).withColumn("rest", F.datediff("end", "start") - F.col("lag"))
    return alive.groupBy((F.col("user_id") % 2 == 0).alias("even"), F.col("error").isNotNull().alias("had_error")).agg(F.count("*").alias("n"), F.avg("rest").alias("mean_rest"), F.median("rest").alias("median_rest"))


def linkage_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """A rule's candidates against known truth: macro precision over cases with candidates, recall, coverage, median set size."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    l = table(spark, d, "lineitem").join(o, "l_orderkey").select("o_custkey", "l_partkey", "l_quantity", "l_discount").withColumn("true", F.col("l_discount") >= 0.08).withColumn("picked", F.col("l_quantity") >= 35)
    s = l.groupBy("o_custkey").agg(F.count_if(F.col("true") & F.col("picked")).alias("both"), F.count_if("true").alias("t"), F.count_if("picked").alias("p")).where("t > 0")
    return s.agg(F.avg(F.when(F.col("p") > 0, F.col("both") / F.col("p"))).alias("precision"), F.avg(F.col("both") / F.col("t")).alias("recall"), F.avg((F.col("p") > 0).cast("double")).alias("coverage"), F.median("p").alias("median_size"))


def field_accuracy_vs_over_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against labelled fields: accuracy where the label is set, over-extraction where it is not, by field and language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    l = table(spark, d, "labels").join(docs, "doc_id")
    p = l.select("lang", F.col("quality").alias("g_quality"), (F.col("n_chars") > 800).cast("int").alias("p_quality"), F.col("toxic").alias("g_toxic"), (F.col("source") < "src3").cast("int").alias("p_toxic"))
    long = p.select("lang", F.expr("stack(2, 'quality', g_quality, p_quality, 'toxic', g_toxic, p_toxic) as (field, gold, predicted)"))
    return long.groupBy("lang", "field").agg(F.count_if(F.col("gold") == 1).alias("n_set"), F.avg(F.when(F.col("gold") == 1, (F.col("predicted") == 1).cast("double"))).alias("accuracy"), F.avg(F.when(F.col("gold") == 0, (F.col("predicted") == 1).cast("double"))).alias("over"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Half of every year and status to test, by an arithmetic order."""
    o = _orders(spark, d).withColumn("k", F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)))
    w = W.partitionBy("year", "o_orderstatus")
    s = o.withColumn("r", F.row_number().over(w.orderBy("k", "o_orderkey"))).withColumn("n", F.count("*").over(w)).withColumn("split", F.when(F.col("r") <= F.floor(F.col("n") * 0.5), "test").otherwise("train"))
    return s.groupBy("year", "o_orderstatus", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three orders of each year and priority."""
    o = _orders(spark, d).withColumn("k", F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)))
    return o.withColumn("r", F.row_number().over(W.partitionBy("year", "o_orderpriority").orderBy("k", "o_orderkey"))).where("r <= 3").select("year", "o_orderpriority", "o_orderkey", "r")


def round_robin_queue(spark: SparkSession, d: str) -> DataFrame:
    """Parts queued one of each brand in turn, the dearest first: the first five of each."""
    p = table(spark, d, "part").withColumn("turn", R.turn(["p_brand"], [F.desc("p_retailprice"), "p_partkey"])).where("turn <= 5")
    return p.select("turn", "p_brand", "p_partkey")


def bunching_weeks_dense(spark: SparkSession, d: str) -> DataFrame:
    """Orders in weeks relative to 1998-08-02, from -26 to 26, weeks without any as zero."""
    w = table(spark, d, "orders").select(F.floor(F.datediff("o_orderdate", F.lit("1998-08-02").cast("date")) / 7).alias("week")).where("week between -26 and 26").groupBy("week").agg(F.count("*").alias("n"))
    return spark.range(-26, 27).withColumnRenamed("id", "week").join(w, "week", "left").na.fill(0, ["n"])


def field_inventory(spark: SparkSession, d: str) -> DataFrame:
    return S.inventory(table(spark, d, "customer").select("c_name", "c_nationkey", "c_mktsegment"), ["c_name", "c_nationkey", "c_mktsegment"])


def commissioner_dissent(spark: SparkSession, d: str) -> DataFrame:
    """Users as voters: errors as noes, purchases as ayes; dissent rate, first and last day, those of at least 10 votes."""
    e = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    v = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("noes"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))
    return v.where("n >= 10").withColumn("dissent", F.col("noes") / F.col("n"))


def net_flow(spark: SparkSession, d: str) -> DataFrame:
    """Line value flowing into a nation's customers less that out of its suppliers, flows within a nation left out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from"))
    f = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").where(F.col("to") != F.col("from")).groupBy("from", "to").agg(F.sum("l_quantity").alias("q"))
    both = f.select(F.col("to").alias("nation"), F.col("q").alias("inflow"), F.lit(0.0).alias("outflow")).unionByName(f.select(F.col("from").alias("nation"), F.lit(0.0).alias("inflow"), F.col("q").alias("outflow")))
    return both.groupBy("nation").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), (F.sum("inflow") - F.sum("outflow")).alias("net"))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return S.spearman(table(spark, d, "part").select("p_size", F.floor(F.col("p_retailprice") / 50).alias("price")), "p_size", "price")


def state_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of each user: how many, and the longest."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    r = e.withColumn("run", R.island(["user_id"], ["ts", "event_id"], F.col("event_type"))).groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return r.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose order and line number repeat: how many rows share one, and how many are not the first."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k"))
    return n.groupBy("l_linenumber").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n_shared"), F.sum(F.col("k") - 1).alias("n_later"))


def principal_line(spark: SparkSession, d: str) -> DataFrame:
    """The principal line of each open order: not returned first, then the dearest, then the earliest shipped."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi")
    best = J.latest_wins(l, ["l_orderkey"], F.asc(F.col("l_returnflag") == "R"), F.desc("l_extendedprice"), F.asc("l_shipdate"), F.asc("l_partkey"))
    return best.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean_price"))


def guarded_rates(spark: SparkSession, d: str) -> DataFrame:
    """Ratios that are null where their base is not positive, clipped amounts, and the smaller and larger of dates."""
    c = table(spark, d, "customer").withColumn("base", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return c.groupBy("c_nationkey").agg(F.avg(F.when(F.col("base") > 0, 1000 / F.col("base"))).alias("mean_ratio"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("clipped"), F.min(F.least("c_acctbal", "base")).alias("least"))


def ols_ladder(spark: SparkSession, d: str) -> DataFrame:
    """R2 of log price on a constant and each further block, by within-cell sums: year, then year and priority, with the residual deviation by degrees of freedom."""
    o = _orders(spark, d).withColumn("y", F.log1p("o_totalprice"))
    cells = o.groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))

    def block(name: str, key: list[str]) -> DataFrame:
        g = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        sst = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
        sse = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
        return g.agg(F.lit(name).alias("block"), F.sum("n").alias("n"), (1 - sse / sst).alias("r2"), F.sqrt(sse / (F.sum("n") - F.count("*"))).alias("residual_sd"))

    return block("year", ["year"]).unionByName(block("year and priority", ["year", "o_orderpriority"]))


def hedonic_within(spark: SparkSession, d: str) -> DataFrame:
    """Slope and fit of log price on the customer's balance, both demeaned by nation and year."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", (F.col("c_acctbal") / 1000).alias("x"))
    o = _orders(spark, d).join(c, "o_custkey").withColumn("y", F.log1p("o_totalprice"))
    g = o.groupBy("c_nationkey", "year").agg(F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.count("*").alias("n"))
    a = g.agg(F.sum(F.col("cxy") * F.col("n")).alias("xy"), F.sum(F.col("vx") * F.col("n")).alias("xx"), F.sum(F.col("vy") * F.col("n")).alias("yy"))
    return a.select((F.col("xy") / F.col("xx")).alias("slope"), (F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).alias("r2_within"))


QUERIES = {f.__name__: f for f in (chain_delay_by_month, first_row_vs_first_nonnull, outcome_rates_smoothed, trailing4_min2, calendar_rolling_mean, composition_pivot_shares, crosstab_margins, multi_cut_moments, within_year_quantile_universe, value_quintile_by_year, deciles_by_edges, weighted_mean_var, weighted_median, variance_decomposition, risk_set_funnel, cell_reweight_stddiff, km_curve, km_quantiles, hazard_90d, cif_curve, landmark_compare, linkage_rule_scores, field_accuracy_vs_over_extraction, stratified_split, stratified_sample, round_robin_queue, bunching_weeks_dense, field_inventory, commissioner_dissent, net_flow, rank_correlation, state_runs, duplicate_flags, principal_line, guarded_rates, ols_ladder, hedonic_within)}

_SPELLS = "sp AS (SELECT o_orderpriority, l_returnflag, floor(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30)::INT AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_KM = f"""{_SPELLS}, g AS (SELECT o_orderpriority, t, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS events FROM sp WHERE t >= 0 GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY t DESC)::BIGINT AS at_risk FROM g),
        km AS (SELECT *, product(1 - events / at_risk) OVER (PARTITION BY o_orderpriority ORDER BY t) AS survival FROM r)"""
_O = "o AS (SELECT *, year(o_orderdate) AS year FROM orders)"

ORACLE_SQL = {
    "chain_delay_by_month": """
        WITH u AS (SELECT user_id, event_type, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events GROUP BY ALL)
        SELECT event_type, count(*) AS n_users, median(days) AS median_days, quantile_cont(days, 0.9) AS p90_days, avg((n > 1)::INT) AS multi_share FROM u GROUP BY 1 HAVING count(*) >= 20""",
    "first_row_vs_first_nonnull": """
        WITH e AS (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events), f AS (SELECT user_id, v AS first_row FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
        SELECT user_id, any_value(first_row) AS first_row, arg_min(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS first_non_null, arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS last_non_null FROM e LEFT JOIN f USING (user_id) GROUP BY 1""",
    "outcome_rates_smoothed": f"WITH {_O}, y AS (SELECT year, count(*) AS n, 100 * avg((o_orderstatus = 'F')::INT) AS rate FROM o GROUP BY 1) SELECT *, avg(rate) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM y",
    "trailing4_min2": """
        WITH q AS (SELECT o_orderstatus, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, count(*) AS n FROM orders GROUP BY ALL)
        SELECT *, CASE WHEN count(n) OVER a >= 2 THEN avg(n) OVER a END AS trailing, CASE WHEN count(n) OVER b >= 2 THEN avg(n) OVER b END AS centred FROM q
        WINDOW a AS (PARTITION BY o_orderstatus ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (PARTITION BY o_orderstatus ORDER BY quarter ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
    "calendar_rolling_mean": """
        WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS total FROM events GROUP BY ALL)
        SELECT *, avg(total) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING) AS mean7 FROM d""",
    "composition_pivot_shares": f"WITH {_O} SELECT year, " + ", ".join(f"avg((o_orderpriority = '{p}')::INT) AS share_{p[0]}" for p in PRIORITIES) + " FROM o GROUP BY 1",
    "crosstab_margins": """
        SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus,
               count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "multi_cut_moments": """
        SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority,
               count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90,
               quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, stddev_samp(o_totalprice) / avg(o_totalprice) AS cv, stddev_samp(ln(o_totalprice)) AS sd_log, count(*) FILTER (WHERE o_totalprice < 0) AS n_negative
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) >= 20""",
    "within_year_quantile_universe": f"""
        WITH {_O}, c AS (SELECT year, quantile_cont(o_totalprice, 0.95) AS cut FROM o GROUP BY 1)
        SELECT year, count(*) FILTER (WHERE o_totalprice >= cut) AS n_dear, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
               count(*) FILTER (WHERE o_totalprice >= cut OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'O') AS n_any FROM o JOIN c USING (year) GROUP BY 1""",
    "value_quintile_by_year": f"WITH {_O}, q AS (SELECT year, o_totalprice, ntile(5) OVER (PARTITION BY year ORDER BY o_totalprice, o_orderkey) AS quintile FROM o) SELECT year, quintile, count(*) AS n, avg(o_totalprice) AS mean_price FROM q GROUP BY ALL",
    "deciles_by_edges": """
        WITH e AS (SELECT quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM customer),
        b AS (SELECT c_acctbal, greatest(1, len(list_filter(e[1:10], lambda x: x < c_acctbal))) AS bin FROM customer, e)
        SELECT bin, count(*) AS n, avg(c_acctbal) AS mean FROM b GROUP BY 1""",
    "weighted_mean_var": "SELECT l_returnflag, sum(l_quantity * l_discount) / sum(l_quantity) AS w_mean, sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_quantity * l_discount) / sum(l_quantity)) ** 2 AS w_var FROM lineitem GROUP BY 1",
    "weighted_median": """
        WITH s AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
        c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
        SELECT l_returnflag, min(x) FILTER (WHERE c >= 0.5 * t) AS w_median FROM c GROUP BY 1""",
    "variance_decomposition": f"""
        WITH {_O}, m AS (SELECT o_totalprice AS x, avg(o_totalprice) OVER () AS a, avg(o_totalprice) OVER (PARTITION BY year) AS y, avg(o_totalprice) OVER (PARTITION BY year, o_orderpriority) AS c FROM o)
        SELECT sum((y - a) ** 2) / sum((x - a) ** 2) AS share_year, sum((c - a) ** 2) / sum((x - a) ** 2) AS share_both FROM m""",
    "risk_set_funnel": f"""
        WITH {_O}, f AS (SELECT o_custkey, o_totalprice > 100000 AS a, o_orderpriority IN ('1-URGENT', '2-HIGH') AS b, o_orderstatus = 'F' AS c, year >= 1998 AS d FROM o),
        s AS (SELECT 0 AS step, 'all' AS name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_units FROM f UNION ALL SELECT 1, 'dear', count(*), count(DISTINCT o_custkey) FROM f WHERE a
              UNION ALL SELECT 2, 'urgent or high', count(*), count(DISTINCT o_custkey) FROM f WHERE a AND b UNION ALL SELECT 3, 'finished', count(*), count(DISTINCT o_custkey) FROM f WHERE a AND b AND c
              UNION ALL SELECT 4, 'late years', count(*), count(DISTINCT o_custkey) FROM f WHERE a AND b AND c AND d)
        SELECT *, coalesce(lag(n_rows) OVER (ORDER BY step) - n_rows, 0) AS lost FROM s""",
    "cell_reweight_stddiff": f"""
        WITH {_O}, x AS (SELECT o_totalprice AS x, o_orderpriority IN ('1-URGENT', '2-HIGH') AS t, c_nationkey, year FROM o JOIN customer ON o_custkey = c_custkey),
        w AS (SELECT *, count(*) FILTER (WHERE t) OVER c AS nt, count(*) FILTER (WHERE NOT t) OVER c AS nc FROM x WINDOW c AS (PARTITION BY c_nationkey, year)),
        v AS (SELECT x, t, CASE WHEN t THEN 1.0 ELSE nt / nc END AS w FROM w WHERE nt > 0 AND nc > 0),
        m AS (SELECT sum(w * x) FILTER (WHERE t) / sum(w) FILTER (WHERE t) AS m1, sum(w * x) FILTER (WHERE NOT t) / sum(w) FILTER (WHERE NOT t) AS m0 FROM v),
        k AS (SELECT any_value(m1) AS mean_1, any_value(m0) AS mean_0, sum(w * (x - m1) ** 2) FILTER (WHERE t) / sum(w) FILTER (WHERE t) AS var_1, sum(w * (x - m0) ** 2) FILTER (WHERE NOT t) / sum(w) FILTER (WHERE NOT t) AS var_0 FROM v, m)
        SELECT *, (mean_1 - mean_0) / sqrt((var_1 + var_0) / 2) AS std_diff FROM k""",
    "km_curve": f"WITH {_KM} SELECT * FROM km",
    "km_quantiles": f"WITH {_KM} SELECT o_orderpriority, min(t) FILTER (WHERE survival <= 0.75) AS p25, min(t) FILTER (WHERE survival <= 0.5) AS p50, min(t) FILTER (WHERE survival <= 0.25) AS p75 FROM km GROUP BY 1",
    "hazard_90d": f"""
        WITH {_SPELLS}, b AS (SELECT o_orderpriority, unnest(range(0, 20)) AS bin FROM (SELECT DISTINCT o_orderpriority FROM sp WHERE t >= 0)),
        h AS (SELECT b.o_orderpriority, bin, count(*) FILTER (WHERE t >= bin * 3) AS at_risk, count(*) FILTER (WHERE t >= bin * 3 AND t < bin * 3 + 3 AND l_returnflag <> 'R') AS events FROM b JOIN sp ON sp.o_orderpriority = b.o_orderpriority AND t >= 0 GROUP BY ALL)
        SELECT *, events / at_risk AS hazard FROM h WHERE at_risk >= 20""",
    "cif_curve": f"""
        WITH {_SPELLS}, g AS (SELECT o_orderpriority, t, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM sp WHERE t >= 0 GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY t DESC)::BIGINT AS at_risk FROM g),
        s AS (SELECT *, product(1 - (a + b) / at_risk) OVER (PARTITION BY o_orderpriority ORDER BY t) AS s FROM r),
        l AS (SELECT *, lag(s, 1, 1.0) OVER (PARTITION BY o_orderpriority ORDER BY t) * a / at_risk AS step FROM s)
        SELECT o_orderpriority, t, at_risk, sum(step) OVER (PARTITION BY o_orderpriority ORDER BY t) AS cif FROM l""",
    "landmark_compare": """
        WITH f AS (SELECT user_id, min(ts)::DATE AS s, max(ts)::DATE AS e, min(ts) FILTER (WHERE event_type = 'error')::DATE AS x FROM events GROUP BY 1),
        p AS (SELECT list_sort(list(date_diff('day', s, x))) AS pool FROM f WHERE x IS NOT NULL),
        g AS (SELECT *, CASE WHEN x IS NOT NULL THEN date_diff('day', s, x) ELSE pool[user_id % len(pool) + 1] END AS lag FROM f, p)
        SELECT user_id % 2 = 0 AS even, x IS NOT NULL AS had_error, count(*) AS n, avg(date_diff('day', s, e) - lag) AS mean_rest, median(date_diff('day', s, e) - lag) AS median_rest FROM g WHERE date_diff('day', s, e) >= lag GROUP BY ALL""",
    "linkage_rule_scores": """
        WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE l_discount >= 0.08 AND l_quantity >= 35) AS b, count(*) FILTER (WHERE l_discount >= 0.08) AS t, count(*) FILTER (WHERE l_quantity >= 35) AS p
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING t > 0)
        SELECT avg(b / p) FILTER (WHERE p > 0) AS precision, avg(b / t) AS recall, avg((p > 0)::INT) AS coverage, median(p) AS median_size FROM s""",
    "field_accuracy_vs_over_extraction": """
        WITH l AS (SELECT lang, 'quality' AS field, quality AS g, (n_chars > 800)::INT AS p FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic, (source < 'src3')::INT FROM labels JOIN documents USING (doc_id))
        SELECT lang, field, count(*) FILTER (WHERE g = 1) AS n_set, avg(p) FILTER (WHERE g = 1) AS accuracy, avg(p) FILTER (WHERE g = 0) AS over FROM l GROUP BY ALL""",
    "stratified_split": f"""
        WITH {_O}, s AS (SELECT *, row_number() OVER (PARTITION BY year, o_orderstatus ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS r, count(*) OVER (PARTITION BY year, o_orderstatus) AS n FROM o)
        SELECT year, o_orderstatus, CASE WHEN r <= floor(n * 0.5) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM s GROUP BY ALL""",
    "stratified_sample": f"WITH {_O} SELECT year, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY year, o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS r FROM o QUALIFY r <= 3",
    "round_robin_queue": "SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn, p_brand, p_partkey FROM part QUALIFY turn <= 5",
    "bunching_weeks_dense": """
        WITH w AS (SELECT floor(date_diff('day', DATE '1998-08-02', o_orderdate::DATE) / 7)::BIGINT AS week, count(*) AS n FROM orders GROUP BY 1)
        SELECT r.week, coalesce(n, 0) AS n FROM (SELECT unnest(range(-26, 27)) AS week) r LEFT JOIN w ON w.week = r.week""",
    "field_inventory": """
        WITH l AS (SELECT 'c_name' AS "column", c_name AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
        c AS (SELECT "column", v, count(*) AS n FROM l GROUP BY ALL)
        SELECT "column", sum(n)::BIGINT AS n_filled, count(*) AS n_distinct, arg_min(v, (-n, v)) AS top_value, max(n) AS top_n,
               CASE WHEN avg(regexp_matches(v, '^-?[0-9]+$')::INT * n) / avg(n) > 0.95 THEN 'number' WHEN count(*) <= 50 THEN 'code' ELSE 'text' END AS kind FROM c GROUP BY 1""",
    "commissioner_dissent": """
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS noes, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day, count(*) FILTER (WHERE event_type = 'error') / count(*) AS dissent
        FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1 HAVING count(*) >= 10""",
    "net_flow": """
        WITH f AS (SELECT s_nationkey AS f, c_nationkey AS t, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
        b AS (SELECT t AS nation, q AS i, 0 AS o FROM f UNION ALL SELECT f, 0, q FROM f)
        SELECT nation, sum(i)::DOUBLE AS inflow, sum(o)::DOUBLE AS outflow, (sum(i) - sum(o))::DOUBLE AS net FROM b GROUP BY 1""",
    "rank_correlation": """
        WITH p AS (SELECT p_size AS x, floor(p_retailprice / 50) AS y FROM part),
        r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p)
        SELECT corr(rx, ry) AS spearman, corr(x, y) AS pearson FROM r""",
    "state_runs": """
        WITH a AS (SELECT user_id, ts, event_id, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
        SELECT user_id, count(*) AS n_runs, max(n) AS longest FROM c GROUP BY 1""",
    "duplicate_flags": """
        WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL)
        SELECT l_linenumber, sum(k)::BIGINT AS n, sum(CASE WHEN k > 1 THEN k ELSE 0 END)::BIGINT AS n_shared, sum(k - 1)::BIGINT AS n_later FROM n GROUP BY 1""",
    "principal_line": """
        WITH b AS (SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_extendedprice DESC, l_shipdate, l_partkey) = 1)
        SELECT l_returnflag, year(l_shipdate) AS year, count(*) AS n, avg(l_extendedprice) AS mean_price FROM b GROUP BY ALL""",
    "guarded_rates": """
        WITH c AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS base FROM customer)
        SELECT c_nationkey, avg(1000 / base) FILTER (WHERE base > 0) AS mean_ratio, sum(greatest(c_acctbal, 0.0)) AS clipped, min(least(c_acctbal, base)) AS least FROM c GROUP BY 1""",
    "ols_ladder": f"""
        WITH {_O}, y AS (SELECT ln(1 + o_totalprice) AS y, year, o_orderpriority AS p FROM o),
        m AS (SELECT y, avg(y) OVER () AS a, avg(y) OVER (PARTITION BY year) AS b, avg(y) OVER (PARTITION BY year, p) AS c FROM y)
        SELECT 'year' AS block, count(*) AS n, 1 - sum((y - b) ** 2) / sum((y - a) ** 2) AS r2, sqrt(sum((y - b) ** 2) / (count(*) - count(DISTINCT b))) AS residual_sd FROM m
        UNION ALL SELECT 'year and priority', count(*), 1 - sum((y - c) ** 2) / sum((y - a) ** 2), sqrt(sum((y - c) ** 2) / (count(*) - count(DISTINCT c))) FROM m""",
    "hedonic_within": f"""
        WITH {_O}, x AS (SELECT c_acctbal / 1000 AS x, ln(1 + o_totalprice) AS y, c_nationkey AS n, year FROM o JOIN customer ON o_custkey = c_custkey),
        d AS (SELECT x - avg(x) OVER (PARTITION BY n, year) AS x, y - avg(y) OVER (PARTITION BY n, year) AS y FROM x)
        SELECT sum(x * y) / sum(x * x) AS slope, sum(x * y) ** 2 / (sum(x * x) * sum(y * y)) AS r2_within FROM d""",
}
