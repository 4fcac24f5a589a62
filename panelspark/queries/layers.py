"""Polygon layers: points in layers, boundary duplicates, overlap fallbacks, overlays, area weights, coverage, kernels.

The tables have no geometry, so keys give it: nations are overlapping squares of a grid, customers points, parts rectangles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import spatial as G
from panelspark.session import table

CELL = 20.0


def _districts(spark: SparkSession, d: str, grow: int = 2) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5) * 20, F.floor(F.col("n_nationkey") / 5) * 20
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("gid"), F.col("n_name").alias("name"), G.rectangle(x - grow, y - grow, x + 20 + grow, y + 20 + grow).alias("rings"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("pid"), ((k * 37 % 1200) / 10 + 0.05).alias("px"), ((k * 91 % 1200) / 10 + 0.05).alias("py"))


def _parcels(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 53 % 1100) / 10, (k * 29 % 1100) / 10
    return table(spark, d, "part").select(k.alias("lid"), x.alias("x"), y.alias("y"), (1 + s % 7).alias("w"), (1 + s % 5).alias("h")).withColumn("rings", G.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def points_in_layer(spark: SparkSession, d: str) -> DataFrame:
    """How many districts each customer lies in: matched, in several, unmatched."""
    m = G.layer_join(_points(spark, d), _districts(spark, d), CELL).groupBy("pid").agg(F.count("gid").alias("k"))
    return m.groupBy("k").agg(F.count("*").alias("n"))


def boundary_first_match(spark: SparkSession, d: str) -> DataFrame:
    """One district a customer: of those it lies in the smallest id; customers by district."""
    m = G.layer_join(_points(spark, d), _districts(spark, d), CELL).groupBy("pid").agg(F.min("gid").alias("gid"))
    return m.groupBy("gid").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


def _overlaps(spark: SparkSession, d: str, grow: int) -> DataFrame:
    return G.overlaps(_parcels(spark, d).select("lid", "rings"), _districts(spark, d, grow).select(F.col("gid").alias("rid"), "rings"), CELL)


def overlap_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A parcel's district by its centroid where that lies in one; else, where it lies in none or several, that of the largest overlap; else none."""
    p = _parcels(spark, d)
    centroid = p.select(F.col("lid").alias("pid"), (F.col("x") + F.col("w") / 2 + 0.003).alias("px"), (F.col("y") + F.col("h") / 2 + 0.003).alias("py"))
    by_point = G.layer_join(centroid, _districts(spark, d), CELL).groupBy("pid").agg(F.count("gid").alias("k"), F.min("gid").alias("gid"))
    failed = p.join(by_point.where("k <> 1"), F.col("lid") == F.col("pid"), "left_semi")
    best = G.largest_overlap(G.overlaps(failed.select("lid", "rings"), _districts(spark, d).select(F.col("gid").alias("rid"), "rings"), CELL))
    out = by_point.join(best, F.col("pid") == F.col("lid"), "left").withColumn("district", F.when(F.col("k") == 1, F.col("gid")).otherwise(F.col("rid"))).withColumn("how", F.when(F.col("k") == 1, "centroid").when(F.col("rid").isNotNull(), "overlap").otherwise("none"))
    return out.groupBy("how").agg(F.count("*").alias("n"), F.sum("district").alias("districts"))


def overlay_lists(spark: SparkSession, d: str) -> DataFrame:
    """All districts that a parcel overlaps, as a sorted list, by how many parcels."""
    names = _districts(spark, d).select(F.col("gid").alias("rid"), "name")
    lists = _overlaps(spark, d, 2).join(names, "rid").groupBy("lid").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("districts"))
    return lists.groupBy("districts").agg(F.count("*").alias("n"))


def area_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """A parcel's area weights over districts and its dominant one where that takes at least half, else "Unincorporated" with the region; counted."""
    p = _parcels(spark, d).select("lid", (F.col("w") * F.col("h")).alias("whole"))
    best = _overlaps(spark, d, -3).join(p, "lid").withColumn("weight", F.round(F.col("area") / F.col("whole"), 9)).groupBy("lid").agg(F.sum("weight").alias("covered"), F.max(F.struct("weight", -F.col("rid"))).alias("b"))
    names = _districts(spark, d).select("gid", "name")
    out = p.join(best, "lid", "left").withColumn("gid", -F.col("b.col2")).withColumn("weight", F.col("b.weight")).join(names, "gid", "left")
    place = F.when(F.col("weight") >= 0.5, F.col("name")).otherwise(F.concat(F.lit("Unincorporated "), F.coalesce("name", F.lit("none"))))
    return out.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.sum("covered").alias("covered"))


def zone_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each parcel's area within any zone, overlapping zones counted twice and clipped to 1, in tenths."""
    p = _parcels(spark, d).select("lid", (F.col("w") * F.col("h")).alias("whole"))
    s = _overlaps(spark, d, 2).groupBy("lid").agg(F.sum("area").alias("area"))
    share = F.least(F.coalesce(F.col("area"), F.lit(0.0)) / F.col("whole"), F.lit(1.0))
    return p.join(s, "lid", "left").groupBy(F.floor(F.round(share * 10, 6)).alias("tenth")).agg(F.count("*").alias("n"), F.avg(share).alias("mean_share"))


def intersecting_areas(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of districts that share ground, and how much."""
    a = _districts(spark, d)
    pairs = G.overlaps(a.select(F.col("gid").alias("lid"), "rings"), a.select(F.col("gid").alias("rid"), "rings"), CELL)
    return pairs.where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"), "area")


def layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Matched, several and unmatched customers of two layers."""
    out = None
    for name, grow in (("wide", 2), ("narrow", -4)):
        k = G.layer_join(_points(spark, d), _districts(spark, d, grow), CELL).groupBy("pid").agg(F.count("gid").alias("k"))
        one = k.agg(F.lit(name).alias("layer"), F.count_if(F.col("k") == 1).alias("matched"), F.count_if(F.col("k") > 1).alias("multi"), F.count_if(F.col("k") == 0).alias("unmatched"))
        out = one if out is None else out.unionByName(one)
    return out


def distance_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Access of each nation: customers of all nations weighted by exp(-distance / 10), and those within 25 and 45. Nations are 25 rows, customers counted first."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") % 5) * 20).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 20).alias("y"))
    jobs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("w"))
    other = n.join(jobs, "k").select(F.col("x").alias("ox"), F.col("y").alias("oy"), "w")
    dist = F.sqrt(F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2)))
    return n.crossJoin(F.broadcast(other)).groupBy("k").agg(F.sum(F.col("w") * F.exp(-dist / 10)).alias("access"), F.sum(F.when(dist <= 25, F.col("w")).otherwise(0)).alias("near"), F.sum(F.when(dist <= 45, F.col("w")).otherwise(0)).alias("far"))


QUERIES = {f.__name__: f for f in (points_in_layer, boundary_first_match, overlap_fallback, overlay_lists, area_crosswalk, zone_shares, intersecting_areas, layer_coverage, distance_kernel)}

_G = "g(g, name, x0, y0, x1, y1) AS (SELECT n_nationkey, n_name, n_nationkey % 5 * 20 - {w}, n_nationkey // 5 * 20 - {w}, n_nationkey % 5 * 20 + 20 + {w}, n_nationkey // 5 * 20 + 20 + {w} FROM nation)"
_P = "p AS (SELECT c_custkey AS pid, c_custkey * 37 % 1200 / 10 + 0.05 AS px, c_custkey * 91 % 1200 / 10 + 0.05 AS py FROM customer)"
_R = "r AS (SELECT p_partkey AS lid, p_partkey * 53 % 1100 / 10 AS x, p_partkey * 29 % 1100 / 10 AS y, 1 + p_size % 7 AS w, 1 + p_size % 5 AS h FROM part)"
_O = "o AS (SELECT lid, g, name, (least(x + w, x1) - greatest(x, x0)) * (least(y + h, y1) - greatest(y, y0)) AS area FROM r JOIN g ON least(x + w, x1) > greatest(x, x0) AND least(y + h, y1) > greatest(y, y0))"
_K = "k AS (SELECT pid, count(g) AS k, min(g) AS g FROM p LEFT JOIN g ON px > x0 AND px < x1 AND py > y0 AND py < y1 GROUP BY 1)"

ORACLE_SQL = {
    "points_in_layer": f"WITH {_G.format(w=2)}, {_P}, {_K} SELECT k, count(*) AS n FROM k GROUP BY 1",
    "boundary_first_match": f"WITH {_G.format(w=2)}, {_P}, {_K} SELECT g AS gid, count(*) AS n, sum(pid)::BIGINT AS pids FROM k GROUP BY 1",
    "overlap_fallback": f"""
        WITH {_G.format(w=2)}, {_R}, {_O}, p AS (SELECT lid AS pid, x + w / 2 + 0.003 AS px, y + h / 2 + 0.003 AS py FROM r), {_K},
        b AS (SELECT lid, g, row_number() OVER (PARTITION BY lid ORDER BY round(area, 9) DESC, g) AS r FROM o),
        j AS (SELECT CASE WHEN k = 1 THEN 'centroid' WHEN b.g IS NOT NULL THEN 'overlap' ELSE 'none' END AS how, CASE WHEN k = 1 THEN k.g ELSE b.g END AS d FROM k LEFT JOIN b ON lid = pid AND r = 1)
        SELECT how, count(*) AS n, sum(d)::BIGINT AS districts FROM j GROUP BY 1""",
    "overlay_lists": f"WITH {_G.format(w=2)}, {_R}, {_O}, l AS (SELECT lid, array_to_string(list_sort(list(name)), '; ') AS districts FROM o GROUP BY 1) SELECT districts, count(*) AS n FROM l GROUP BY 1",
    "area_crosswalk": f"""
        WITH {_G.format(w=-3)}, {_R}, {_O}, s AS (SELECT o.lid, g, name, round(area / (w * h), 9) AS weight FROM o JOIN r USING (lid)),
        b AS (SELECT lid, weight, name, sum(weight) OVER (PARTITION BY lid) AS covered, row_number() OVER (PARTITION BY lid ORDER BY weight DESC, g) AS r FROM s)
        SELECT CASE WHEN weight >= 0.5 THEN name ELSE 'Unincorporated ' || coalesce(name, 'none') END AS place, count(*) AS n, sum(covered) AS covered FROM r LEFT JOIN b ON b.lid = r.lid AND b.r = 1 GROUP BY 1""",
    "zone_shares": f"""
        WITH {_G.format(w=2)}, {_R}, {_O}, s AS (SELECT lid, sum(area) AS a FROM o GROUP BY 1), t AS (SELECT least(coalesce(a, 0) / (w * h), 1.0) AS share FROM r LEFT JOIN s USING (lid))
        SELECT floor(round(share * 10, 6))::BIGINT AS tenth, count(*) AS n, avg(share) AS mean_share FROM t GROUP BY 1""",
    "intersecting_areas": f"WITH {_G.format(w=2)} SELECT a.g AS a, b.g AS b, ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS area FROM g a JOIN g b ON a.g < b.g AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)",
    "layer_coverage": f"""
        SELECT 'wide' AS layer, count(*) FILTER (k = 1) AS matched, count(*) FILTER (k > 1) AS multi, count(*) FILTER (k = 0) AS unmatched FROM (WITH {_G.format(w=2)}, {_P}, {_K} SELECT k FROM k)
        UNION ALL SELECT 'narrow', count(*) FILTER (k = 1), count(*) FILTER (k > 1), count(*) FILTER (k = 0) FROM (WITH {_G.format(w=-4)}, {_P}, {_K} SELECT k FROM k)""",
    "distance_kernel": """
        WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 * 20 AS x, n_nationkey // 5 * 20 AS y FROM nation), j AS (SELECT x, y, count(*) AS w FROM n JOIN customer ON c_nationkey = k GROUP BY 1, 2),
        d AS (SELECT k, w, sqrt((n.x - j.x) ** 2 + (n.y - j.y) ** 2) AS d FROM n, j) SELECT k, sum(w * exp(-d / 10)) AS access, sum(CASE WHEN d <= 25 THEN w ELSE 0 END)::BIGINT AS near, sum(CASE WHEN d <= 45 THEN w ELSE 0 END)::BIGINT AS far FROM d GROUP BY 1""",
}
