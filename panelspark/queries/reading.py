"""Records of documents, names over rolls, and landmark comparisons over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import conditions as C
from panelspark.operators import landmarks as L
from panelspark.operators import names as N
from panelspark.session import table

SEEDS = (1, 2, 3, 4, 5)


def document_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that sections of all documents make, by what their key is taken from: records, canonical ones, lines and conditions."""
    r = C.records_of(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return r.groupBy("key_source").agg(F.count("*").alias("n"), F.count_if("canonical").alias("n_canonical"), F.sum("n_lines").alias("n_lines"), F.sum("n_conditions").alias("n_conditions"))


def roster_names(spark: SparkSession, d: str) -> DataFrame:
    """Clients' printed names as rolls of their cities, over which the newest record of a city presides: printed and settled names by whether the surname is shared."""
    c = table(spark, d, "clients").select("client_id", "name", "city", "updated_at").where("name is not null and city is not null")
    rolls = c.select(F.col("city").alias("meeting"), F.lit("present").alias("side"), F.col("client_id").alias("place"), "name")
    chairs = c.groupBy(F.col("city").alias("meeting")).agg(F.max_by("name", F.struct("updated_at", "client_id")).alias("name"))
    told = N.settled(rolls, chairs)
    return told.groupBy(F.col("person").contains(" ").alias("full")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_printed"), F.countDistinct("person").alias("n_persons"))


def landmark_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line against the rest, from the first return on, or a lag drawn from the returned ones of their priority and year, under five seeds: those alive then, reweighted within cells."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))).alias("event"), F.max(F.to_date("l_shipdate")).alias("last"))
    o = table(spark, d, "orders").join(l, "o_orderkey")
    units = o.select(
        F.col("o_orderkey").alias("id"), F.col("event").isNotNull().alias("treated"), F.to_date("o_orderdate").alias("start"), "event",
        F.when(F.col("o_orderstatus") != "P", F.col("last")).alias("done"), F.when(F.col("o_orderstatus") == "P", F.col("last")).alias("left"), "o_orderpriority", F.year("o_orderdate").alias("year"),
    )
    placed = L.landmarks(units, ["o_orderpriority", "year"], SEEDS, lambda i, s: i * F.lit(7919) * s + s * F.lit(104729))
    return L.compared(placed, ["o_orderpriority", "year"])


QUERIES = {f.__name__: f for f in (document_records, roster_names, landmark_seeds)}

ORACLE_SQL = {
    "document_records": r"""
        WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(coalesce(text, ''), '\r?\n')), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS said FROM documents WHERE doc_id IS NOT NULL),
        k AS (SELECT doc_id, nullif(regexp_extract(said, '(?i)\b(?:case|record|file)\s+(?:no\.?|number|#)\s*[:.]?\s*((?:19|20)?\d{2}[.\-]\d{3,6}[A-Z]{0,16})\b', 1), '') AS c
              FROM l WHERE said <> '' AND NOT regexp_matches(said, '(?i)^(?:page\s+)?(?:\d{1,3}|[ivx]{1,5})(?:\s+of\s+\d{1,3})?$')),
        r AS (SELECT doc_id, count(*) AS n, count(c) AS cases FROM k GROUP BY 1)
        SELECT CASE WHEN cases > 0 THEN 'case' ELSE 'document' END AS key_source, count(*) AS n, count(*) AS n_canonical, sum(n)::BIGINT AS n_lines, 0 AS n_conditions FROM r GROUP BY 1""",
    "landmark_seeds": """
        WITH l AS (SELECT l_orderkey, min(l_shipdate::DATE) FILTER (l_returnflag = 'R') AS event, max(l_shipdate::DATE) AS last FROM lineitem GROUP BY 1),
        u AS (SELECT o_orderkey AS id, event IS NOT NULL AS treated, o_orderdate::DATE AS start, event, CASE WHEN o_orderstatus <> 'P' THEN last END AS done, CASE WHEN o_orderstatus = 'P' THEN last END AS gone, o_orderpriority AS p, year(o_orderdate) AS s
              FROM orders JOIN l ON l_orderkey = o_orderkey),
        lags AS (SELECT p, s, event - start AS lag, row_number() OVER (PARTITION BY p, s ORDER BY event - start) - 1 AS place FROM u WHERE treated AND event >= start),
        size AS (SELECT p, s, count(*) AS size FROM lags GROUP BY ALL),
        d AS (SELECT u.*, seed, ((id * 7919 * seed + seed * 104729) % size) AS place FROM u LEFT JOIN size USING (p, s), range(1, 6) r(seed)),
        m AS (SELECT d.*, CASE WHEN treated THEN CASE WHEN event >= start THEN event END ELSE start + lag::INT END AS mark FROM d LEFT JOIN lags ON lags.p = d.p AND lags.s = d.s AND lags.place = d.place),
        a AS (SELECT *, (done - mark)::DOUBLE AS days, (done IS NOT NULL)::INT::DOUBLE AS finished, (gone IS NOT NULL)::INT::DOUBLE AS left_ FROM m WHERE mark IS NOT NULL AND start <= mark AND NOT coalesce(done <= mark, false) AND NOT coalesce(gone <= mark, false)),
        n AS (SELECT seed, count(*) FILTER (treated) AS n_treated, count(*) FILTER (NOT treated) AS n_others FROM a GROUP BY 1),
        c AS (SELECT seed, p, s, count(*) FILTER (treated) AS t, count(*) FILTER (NOT treated) AS c FROM a GROUP BY ALL),
        w AS (SELECT a.*, CASE WHEN treated THEN 1.0 ELSE t / c END AS w FROM a JOIN c USING (seed, p, s) WHERE t > 0 AND c > 0),
        x AS (SELECT seed, treated, 'days' AS k, days AS x, w FROM w WHERE days IS NOT NULL UNION ALL SELECT seed, treated, 'finished', finished, w FROM w UNION ALL SELECT seed, treated, 'gone', left_, w FROM w),
        g AS (SELECT seed, treated, k, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS v FROM x GROUP BY ALL),
        f AS (SELECT i.seed, i.k, i.m AS m1, o.m AS m0, (i.m - o.m) / nullif(sqrt((i.v + o.v) / 2), 0) AS diff FROM g i JOIN g o ON i.seed = o.seed AND i.k = o.k AND i.treated AND NOT o.treated)
        SELECT n.seed::INT AS seed, n_treated, n_others, (SELECT count(*) FROM w WHERE w.seed = n.seed AND treated) AS n_support,
               max(m1) FILTER (k = 'days') AS days_treated, max(m0) FILTER (k = 'days') AS days_others, max(diff) FILTER (k = 'days') AS days_difference,
               max(m1) FILTER (k = 'finished') AS finished_treated, max(m0) FILTER (k = 'finished') AS finished_others, max(diff) FILTER (k = 'finished') AS finished_difference,
               max(m1) FILTER (k = 'gone') AS gone_treated, max(m0) FILTER (k = 'gone') AS gone_others, max(diff) FILTER (k = 'gone') AS gone_difference
        FROM n JOIN f USING (seed) GROUP BY ALL""",
}
