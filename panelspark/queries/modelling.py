"""Models with blocks of covariates, price surfaces, vintage panels, and overlays of concave layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import models as M
from panelspark.operators import resolvers as V
from panelspark.operators import spatial as G
from panelspark.queries.evaluating import _cases
from panelspark.session import table

CELL = 20.0


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Cases with what is known of them at the start: priority, status, quantity, and the customer's nation and segment."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey")
    return _cases(spark, d).join(own, "o_orderkey").withColumn("yr", F.col("year").cast("string"))


def block_ladder(spark: SparkSession, d: str) -> DataFrame:
    """How much each further block of observables explains of the log delay: n, rank, R2, adjusted R2, residual deviation."""
    steps, blocks = [], []
    for name, numeric, block in (("priority", [], "o_orderpriority"), ("status", [], "o_orderstatus"), ("quantity", ["quantity"], None), ("segment", ["quantity"], "segment"), ("nation", ["quantity"], "nation"), ("year", ["quantity"], "yr")):
        blocks = [*blocks, block] if block else blocks
        steps.append((name, numeric, list(blocks)))
    return M.ladder(_observed(spark, d), "ly", steps)


def tail_models(spark: SparkSession, d: str) -> DataFrame:
    """The full model of the log delay and of both tails: fit, base rate and residual deviation."""
    c, rows = _observed(spark, d), []
    for y in ("ly", "d180", "d365"):
        f = M.least_squares(c, y, ["quantity"], ["o_orderpriority", "o_orderstatus", "segment", "nation", "yr"])
        rows.append((y, f.n, f.r2, f.mean, f.sd))
    return spark.createDataFrame(rows, "outcome string, n long, r2 double, base double, residual_sd double")


def block_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The model without years, fitted on cases to 1996, on later ones: cases of levels that training lacks are counted and left out; tails are clipped to 0..1."""
    c = _observed(spark, d)
    train, test = c.where("year <= 1996 and not (o_orderpriority = '1-URGENT' and year < 2000)"), c.where("year > 1996")
    rows = []
    for y in ("ly", "d180", "d365"):
        r = M.forecast(train, test, y, ["quantity"], ["o_orderpriority", "o_orderstatus", "segment", "nation"], None if y == "ly" else (0.0, 1.0))
        rows.append((y, r["n_train"], r["n_test"], r["n_dropped"], r["r2_in"], r["r2_out"], r["mean_out"]))
    return spark.createDataFrame(rows, "outcome string, n_train long, n_test long, n_dropped long, r2_in double, r2_out double, mean_out double")


def covariate_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantile lines of the log price on the customer's balance, the number of lines and an urgent flag."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 1000).alias("balance"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").join(c, "o_custkey").join(n, "o_orderkey").select(F.ln("o_totalprice").alias("y"), "balance", "lines", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    rows = [(t, *beta, 1 - loss / plain if plain else None) for t, (beta, loss, plain) in M.quantile_lines(o, "y", ["balance", "lines", "urgent"], (0.25, 0.5, 0.9), sharp=1e-5).items() if beta]
    return spark.createDataFrame(rows, "tau double, constant double, b_balance double, b_lines double, b_urgent double, pseudo_r2 double")


def _sales(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 1000).alias("x"))
    o = table(spark, d, "orders").join(c, "o_custkey")
    return o.select("o_orderkey", "o_custkey", "nation", F.year("o_orderdate").alias("year"), "x", F.ln("o_totalprice").alias("ly"))


def price_surface(spark: SparkSession, d: str) -> DataFrame:
    """A log price for every nation and year with the balance's slope within them, fitted on four fifths of the orders and tried on the rest; one nation's orders of even years are all held out."""
    s = _sales(spark, d)
    return M.surface_scores(s, "ly", ["x"], ["nation", "year"], (F.col("o_orderkey") % 5 == 0) | ((F.col("nation") == 3) & (F.col("year") % 2 == 0)))


def imputed_prices(spark: SparkSession, d: str) -> DataFrame:
    """A price for every customer and year: what the customer paid that year on average, else what the surface of all orders says."""
    s = _sales(spark, d)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 1000).alias("x"))
    panel = people.withColumn("year", F.explode(F.sequence(F.lit(1994), F.lit(2000))))
    made = M.surface(s, "ly", ["x"], ["nation", "year"])
    p = M.observed_or_imputed(panel, s.select("o_custkey", "year", "ly"), made, ["o_custkey", "year"], "price")
    return p.groupBy("year", "imputed").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"))


def _zones(spark: SparkSession, d: str, grow: int) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5) * 20, F.floor(F.col("n_nationkey") / 5) * 20
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("gid"), G.rectangle(x - grow, y - grow, x + 20 - grow, y + 20 - grow).alias("rings"))


def parcel_year_panel(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's zone in every year of its life: tables of 2001 and 2002, layers of 2004 and 2006 that lie elsewhere each time, and the layer of today carried forward; 2003 and 2005 are served by none."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    live = c.select(k.alias("id"), F.when(k % 3 != 0, 2000 + k % 5).alias("y0"), F.when(k % 4 != 0, 2004 + k % 6).alias("y1"))
    points = c.select(k.alias("pid"), ((k * 37 % 1000) / 10 + 0.05).alias("px"), ((k * 91 % 1000) / 10 + 0.05).alias("py"))
    keyed = c.select(k.alias("id"), F.explode(F.array(F.lit(2001), F.lit(2002))).alias("year"), (F.col("c_nationkey") % 7).alias("value")).where("id % 10 <> 1")
    at = lambda grow: G.layer_join(points, _zones(spark, d, grow), CELL).where("gid is not null").select(F.col("pid").alias("id"), F.col("gid").alias("value"))
    spatial = at(1).withColumn("year", F.lit(2004)).unionByName(at(2).withColumn("year", F.lit(2006)))
    p = V.vintage_panel(live, keyed, spatial, at(3), 2000, 2009)
    return p.groupBy("year", "vintage", "is_snapshot", "method").agg(F.count("*").alias("n"), F.count("value").alias("n_zoned"), F.sum("value").alias("zones"))


def concave_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Parts as L-shaped ground shared among nations' squares that have a court in the middle and an island of their own: parcels and weights by nation, none being what no nation covers; the weights of a parcel sum to 1."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, w, h = (k * 53 % 1100) / 10, (k * 29 % 1100) / 10, 1 + s % 7, 1 + s % 5
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(point(x, y), point(x + w, y), point(x + w, y + h / 2), point(x + w / 2, y + h / 2), point(x + w / 2, y + h), point(x, y + h))
    parcels = table(spark, d, "part").select(k.alias("lid"), F.array(ring).alias("rings"))
    n = F.col("n_nationkey")
    u, v = n % 5 * 20, F.floor(n / 5) * 20
    box = lambda x0, y0, x1, y1: G.rectangle(x0, y0, x1, y1)[0]
    # The court runs the same way round as the square, as rings do in the wild; the island lies in the next square's court.
    rings = F.array(box(u, v, u + 20, v + 20), box(u + 6, v + 6, u + 14, v + 14), box(u + 28, v + 8, u + 32, v + 12))
    shared = G.crosswalk(parcels, table(spark, d, "nation").select(n.alias("rid"), rings.alias("rings")), CELL)
    sums = shared.groupBy("lid").agg(F.sum("weight").alias("whole"))
    by = shared.join(sums, "lid").groupBy(F.coalesce("rid", F.lit(-1)).alias("rid"))
    return by.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.sum("area"), 6).alias("area"), F.count_if(F.abs(F.col("whole") - 1) < 1e-9).alias("n_whole"))


QUERIES = {f.__name__: f for f in (block_ladder, tail_models, block_forecast, covariate_quantiles, price_surface, imputed_prices, parcel_year_panel, concave_crosswalk)}

_SALES = "s AS (SELECT o_orderkey, o_custkey, c_nationkey AS nation, year(o_orderdate) AS year, c_acctbal / 1000 AS x, ln(o_totalprice) AS ly FROM orders JOIN customer ON o_custkey = c_custkey)"
_FIT = """c AS (SELECT nation, year, avg(ly) AS my, avg(x) AS mx FROM tr GROUP BY ALL),
        b AS (SELECT sum((x - mx) * (ly - my)) / sum((x - mx) ** 2) AS b, avg(ly) AS gy, avg(x) AS gx FROM tr JOIN c USING (nation, year))"""
_ZONE = "(SELECT c_custkey AS id, n_nationkey AS value FROM customer, nation WHERE c_custkey * 37 % 1000 / 10 + 0.05 > n_nationkey % 5 * 20 - {g} AND c_custkey * 37 % 1000 / 10 + 0.05 < n_nationkey % 5 * 20 + 20 - {g} AND c_custkey * 91 % 1000 / 10 + 0.05 > n_nationkey // 5 * 20 - {g} AND c_custkey * 91 % 1000 / 10 + 0.05 < n_nationkey // 5 * 20 + 20 - {g})"

ORACLE_SQL = {
    "price_surface": f"""
        WITH {_SALES}, h AS (SELECT *, o_orderkey % 5 = 0 OR (nation = 3 AND year % 2 = 0) AS held FROM s), tr AS (SELECT * FROM h WHERE NOT held), {_FIT},
        t AS (SELECT h.ly, c.my IS NULL AS alone, h.ly - coalesce(my, gy) - (x - coalesce(mx, gx)) * b AS e FROM h LEFT JOIN c USING (nation, year), b WHERE held)
        SELECT (SELECT count(*) FROM tr) AS n_train, count(*) AS n_test, count(*) FILTER (alone) AS n_no_cell, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(ly) AS r2, avg(e) AS bias FROM t""",
    "imputed_prices": f"""
        WITH {_SALES}, tr AS (SELECT * FROM s), {_FIT}, o AS (SELECT o_custkey, year, avg(ly) AS seen FROM s GROUP BY ALL),
        p AS (SELECT c_custkey AS o_custkey, c_nationkey AS nation, c_acctbal / 1000 AS x, y AS year FROM customer, range(1994, 2001) r(y)),
        m AS (SELECT p.year, seen IS NULL AS imputed, coalesce(seen, coalesce(my, gy) + (x - coalesce(mx, gx)) * b) AS price FROM p LEFT JOIN o USING (o_custkey, year) LEFT JOIN c USING (nation, year), b)
        SELECT year, imputed, count(*) AS n, avg(price) AS mean_price FROM m GROUP BY ALL""",
    "parcel_year_panel": f"""
        WITH l AS (SELECT c_custkey AS id, c_nationkey % 7 AS k, y AS year FROM customer, range(2000, 2010) r(y)
                   WHERE (c_custkey % 3 = 0 OR y >= 2000 + c_custkey % 5) AND (c_custkey % 4 = 0 OR y <= 2004 + c_custkey % 6)),
        v AS (SELECT id, year, k AS value FROM l WHERE year IN (2001, 2002) AND id % 10 <> 1
              UNION ALL SELECT id, 2004, min(value) FROM {_ZONE.format(g=1)} GROUP BY id UNION ALL SELECT id, 2006, min(value) FROM {_ZONE.format(g=2)} GROUP BY id
              UNION ALL SELECT id, y, min(value) FROM {_ZONE.format(g=3)}, range(2007, 2010) r(y) GROUP BY id, y)
        SELECT year::INT AS year, CASE WHEN year <= 2002 THEN 'table ' || year WHEN year <= 2006 THEN 'layer ' || year ELSE 'current layer, carried forward' END AS vintage, year > 2006 AS is_snapshot,
               CASE WHEN year <= 2002 THEN 'table' ELSE 'spatial' END AS method, count(*) AS n, count(value) AS n_zoned, sum(value)::BIGINT AS zones
        FROM l LEFT JOIN v USING (id, year) WHERE year IN (2001, 2002, 2004, 2006, 2007, 2008, 2009) GROUP BY ALL""",
    "concave_crosswalk": """
        WITH p AS (SELECT p_partkey AS lid, p_partkey * 53 % 1100 / 10 AS x, p_partkey * 29 % 1100 / 10 AS y, 1 + p_size % 7 AS w, 1 + p_size % 5 AS h FROM part),
        l AS (SELECT lid, x AS x0, y AS y0, x + w AS x1, y + h AS y1, 1 AS s FROM p UNION ALL SELECT lid, x + w / 2, y + h / 2, x + w, y + h, -1 FROM p),
        n AS (SELECT n_nationkey AS rid, n_nationkey % 5 * 20 AS u, n_nationkey // 5 * 20 AS v FROM nation),
        r AS (SELECT rid, u AS x0, v AS y0, u + 20 AS x1, v + 20 AS y1, 1 AS s FROM n UNION ALL SELECT rid, u + 6, v + 6, u + 14, v + 14, -1 FROM n UNION ALL SELECT rid, u + 28, v + 8, u + 32, v + 12, 1 FROM n),
        o AS (SELECT lid, rid, sum(l.s * r.s * greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0) * greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0)) AS area
              FROM l JOIN r ON least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0) GROUP BY ALL),
        a AS (SELECT lid, w * h * 0.75 AS whole FROM p), t AS (SELECT lid, sum(area) AS taken FROM o GROUP BY 1),
        e AS (SELECT lid, rid, area, area / whole AS weight FROM o JOIN a USING (lid) WHERE area > 1e-9 UNION ALL
              SELECT lid, -1, whole - coalesce(taken, 0), 1 - coalesce(taken, 0) / whole FROM a LEFT JOIN t USING (lid) WHERE whole - coalesce(taken, 0) > whole * 1e-9)
        SELECT rid, count(*) AS n, round(sum(weight), 6) AS weight, round(sum(area), 6) AS area, count(*) AS n_whole FROM e GROUP BY 1""",
}
