"""Blocks cut anew over whole documents, and an inventory of rules that prices what it is sure of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import blocks as B
from panelspark.operators import candidates as C
from panelspark.operators import laws as L
from panelspark.operators import positions as P
from panelspark.session import table


def resplit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks, cut before the second and later of their lines that begin with a capital and hold a digit up to the next such line: fragments by language and whether they kept an id, their places and characters."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("place"), "text", "lang").withColumn("doc", F.col("doc_id"))
    f = B.resplit(docs, "doc", "doc_id", "place", "text", lambda t: B.decisions(t, r"[A-Z]", r"[0-9]"), ("lang",))
    return f.groupBy("lang", F.col("doc_id").isNotNull().alias("kept")).agg(F.count("*").alias("n"), F.max("place").alias("last_place"), F.sum(F.length("text")).alias("chars"))


def document_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that all documents and turns hold, by source and kind: how many, in how many texts, and their characters."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit("conversations").alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    i = docs.unionByName(turns).select("part", "id", F.explode(B.items(F.col("text"))).alias("i"))
    return i.groupBy("part", F.col("i.kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_texts"), F.sum(F.length("i.body")).alias("chars"))


def _month(day: Column) -> Column:
    return F.to_date(F.date_trunc("month", day))


def _sales_as_laws(spark: SparkSession, d: str) -> DataFrame:
    """Sales as laws of their client, enacted in the month they were sold, a claim that is verified where the sale arrived within a day; lines shipped give notes, verified where the line was kept. Done sales are noted, open ones count at once."""
    # Of a sale that stands there more than once, the row that arrived first.
    rest = ("arrived_at", "sold_at", "client_id", "status", "total", "priority")
    s = table(spark, d, "sales").where("sale_id is not null").groupBy("sale_id").agg(F.min(F.struct(*rest)).alias("r")).select("sale_id", "r.*")
    kind = F.when(F.col("status") == "done", L.NOTED).when(F.col("status") == "open", L.AT_ONCE).otherwise(L.CODE)
    laws = s.select(F.col("sale_id").alias("law"), F.col("client_id").alias("family"), kind.alias("kind"), "total", "priority")
    prompt = F.col("arrived_at") < F.col("sold_at") + F.expr("INTERVAL 1 DAY")
    sold = s.select(F.col("sale_id").alias("law"), F.explode(F.array(F.lit("enacted"), F.lit("at_once"))).alias("field"), _month(F.col("sold_at")).alias("value"), prompt.alias("verified"))
    shipped = table(spark, d, "sale_lines").where("sale_id is not null").select(F.col("sale_id").alias("law"), F.lit("effective").alias("field"), _month(F.col("shipped_at")).alias("value"), (F.col("flag") == "kept").alias("verified"))
    return L.inventory(laws, sold.unionByName(shipped), lambda day: F.add_months(day, 1))


def law_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory of sales as laws, where a client's shipments in the month after the sale make a rule only if every verified note follows it: laws by basis and state of their claims."""
    i = _sales_as_laws(spark, d)
    return i.groupBy("basis", "verified").agg(F.count("*").alias("n"), F.count("effective").alias("n_dated"), F.sum("n_claims").alias("n_claims"), F.min("effective").alias("first"), F.max("effective").alias("last"))


def law_prices(spark: SparkSession, d: str) -> DataFrame:
    """What sales come to by priority at the end of each month, counting those in force then, and of it what rests on an inferred date."""
    i = _sales_as_laws(spark, d).where("effective is not null").withColumn("day", F.explode(F.sequence(F.lit("2024-02-01").cast("date"), F.lit("2024-06-01").cast("date"), F.expr("INTERVAL 1 MONTH"))))
    cents = F.round(F.col("total") * 100).cast("long")
    return i.where(L.counts_on(F.date_sub("day", 1))).groupBy("day", "priority").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.coalesce(F.sum(F.when(F.col("basis") == "inferred", cents)), F.lit(0)).alias("inferred_cents"))


def candidate_places(spark: SparkSession, d: str) -> DataFrame:
    """Places where papers of orders may be: orders as cases of their buyer and year with a suffix by priority, parts of their lines as motions or resolutions; by family the places, keys and the last place."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey", F.substring("o_orderpriority", 3, 1).alias("s"), "o_orderkey")
    cases = o.select(F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), "s").alias("cn"), F.concat(F.col("y").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"), F.lit(" "), "s").alias("raw"))
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n"), F.when(F.col("l_returnflag") == "R", "resolution").otherwise("motion").alias("i"), F.year("l_shipdate").alias("y"))
    # A form tells its stem, so a stem is a key beside its cases, whose forms are each counted once; a row says whether it is of such a whole.
    key = lambda whole, k, forms: F.struct(F.lit(whole).alias("whole"), F.col(k).alias("key"), F.col(forms).alias("form"))
    keys = C.case_forms(cases, "cn", "raw").select(F.inline(F.array(key(False, "case", "variants"), key(True, "stem", "together")))).where("form is not null")
    filed = C.candidates(keys, "key", "form", {"packets": ("packets/{form}.pdf", False), "archive": ("archive/{form}.pdf", True)}, "whole")
    one = ~F.col("whole")
    filed = filed.select("family", one.cast("long").alias("n"), (one & (F.col("key") == F.col("variant"))).alias("own"), F.col("whole").alias("form"), F.when(one, F.length("place")).alias("chars"), F.when(one, F.col("place")).alias("place"))
    # A number's forms have a place for each of its years. A number is one of its own forms.
    dated = C.candidates(C.instrument_forms(l, "n", "i", "y"), "number", "forms", {"motions": ("motions/{year}/{forms}.pdf", False)})
    dated = dated.groupBy("key", "family", "variant").agg(F.count("*").alias("n"), (F.col("key") == F.col("variant")).alias("own"), F.lit(True).alias("form"), F.sum(F.length("place")).alias("chars"), F.max("place").alias("place"))
    return _families(filed, ("packets", "archive")).unionByName(_families(dated, ("motions",)))


def _families(forms: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """A row for each of a few families that has places; all are read in one pass, since a largest text by group would sort the rows."""

    def told(family: str) -> Column:
        of = F.col("family") == family
        values = {"n": F.sum(F.when(of, F.col("n"))), "n_keys": F.count_if(of & F.col("own")), "n_variants": F.count_if(of & F.col("form")), "chars": F.sum(F.when(of, F.col("chars"))), "last_place": F.max(F.when(of, F.col("place")))}
        return F.struct(F.lit(family).alias("family"), *[v.alias(c) for c, v in values.items()])

    return forms.agg(F.array(*[told(f) for f in families]).alias("r")).select(F.inline("r")).where("n > 0")


def _sale_marks(spark: SparkSession, d: str) -> DataFrame:
    """Sales as marks: their client, day and second."""
    s = table(spark, d, "sales")
    return s.select(F.col("client_id").alias("doc"), F.to_date("sold_at").cast("string").alias("date"), F.unix_timestamp("sold_at").alias("place"))


def purchase_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Clients' purchases by click as boundaries found, their sales as those marked: scores by day and one to one within an hour."""
    c = table(spark, d, "clicks").where("kind = 'purchase'").select(F.col("client_id").alias("doc"), F.to_date("ts").cast("string").alias("date"), F.unix_timestamp("ts").alias("place"))
    return P.boundary_scores(_sale_marks(spark, d), c, 3600)


def dates_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Clients' clicks as blocks in the order of their ids, dated by the last sale at or before them: by kind how many have a date, and how many arrived on it."""
    # Of rows with one click and client, the smallest in time, kind and arrival.
    one = table(spark, d, "clicks").where("client_id is not null and click_id is not null").groupBy("client_id", "click_id").agg(F.min(F.struct("ts", "kind", "arrived_at")).alias("r")).select("client_id", "click_id", "r.*")
    b = one.select(F.col("client_id").alias("doc"), F.col("click_id").alias("block"), F.unix_timestamp("ts").alias("place"), F.concat_ws("|", F.coalesce("kind", F.lit("")), F.to_date("arrived_at").cast("string")).alias("date"))
    w = P.block_dates(_sale_marks(spark, d), b)
    return w.groupBy(F.substring_index("date", "|", 1).alias("kind")).agg(F.count("*").alias("n"), F.count("want").alias("n_dated"), F.count_if(F.coalesce(F.substring_index("date", "|", -1) == F.col("want"), F.lit(False))).alias("n_same"), F.max("want").alias("last"))


QUERIES = {"resplit_documents": resplit_documents, "document_items": document_items, "law_inventory": law_inventory, "law_prices": law_prices, "candidate_places": candidate_places, "purchase_boundaries": purchase_boundaries, "dates_of_blocks": dates_of_blocks}

_INVENTORY = """
    laws AS (SELECT DISTINCT ON (sale_id) sale_id, client_id, status, total, priority, sold_at, arrived_at FROM sales WHERE sale_id IS NOT NULL ORDER BY sale_id, arrived_at NULLS FIRST, sold_at NULLS FIRST, client_id NULLS FIRST, status NULLS FIRST, total NULLS FIRST, priority NULLS FIRST),
    notes AS (SELECT sale_id, min(date_trunc('month', shipped_at)::DATE) FILTER (flag = 'kept') AS note, count(*) AS n, count(*) FILTER (flag = 'kept') AS ok FROM sale_lines GROUP BY 1),
    known AS (SELECT l.*, note, coalesce(n, 0) + 2 AS n_claims, coalesce(ok, 0) + CASE WHEN arrived_at < sold_at + INTERVAL 1 DAY THEN 2 ELSE 0 END AS n_ok,
        CASE WHEN arrived_at < sold_at + INTERVAL 1 DAY THEN date_trunc('month', sold_at)::DATE END AS enacted, coalesce(arrived_at < sold_at + INTERVAL 1 DAY, false) AS prompt FROM laws l LEFT JOIN notes USING (sale_id)),
    families AS (SELECT client_id, bool_and(note = (enacted + INTERVAL 1 MONTH)::DATE) AS follows FROM known WHERE status = 'done' AND note IS NOT NULL AND enacted IS NOT NULL GROUP BY 1),
    inv AS (SELECT k.priority, k.total, k.n_claims,
        CASE WHEN n_ok = 0 THEN 'unverified' WHEN n_ok = n_claims THEN 'yes' ELSE 'partial' END AS verified,
        CASE WHEN status = 'done' AND note IS NOT NULL THEN note WHEN status = 'done' AND follows THEN (enacted + INTERVAL 1 MONTH)::DATE WHEN status = 'open' AND prompt THEN enacted END AS effective,
        CASE WHEN status = 'done' AND note IS NOT NULL THEN 'history note' WHEN status = 'done' AND follows AND enacted IS NOT NULL THEN 'inferred' WHEN status = 'open' AND prompt AND enacted IS NOT NULL THEN 'takes effect at once'
             WHEN status = 'done' OR status = 'open' THEN NULL ELSE 'code in force' END AS basis
        FROM known k LEFT JOIN families f ON k.client_id IS NOT DISTINCT FROM f.client_id)"""

ORACLE_SQL = {
    "resplit_documents": r"""
        WITH lines AS (SELECT doc_id, lang, i, string_split(coalesce(text, ''), chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
        spans AS (SELECT *, count(*) FILTER (regexp_matches(s, '^[ \t\r\f\x0B]*[A-Z]')) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM lines),
        pieces AS (SELECT doc_id, lang, span, string_agg(s, chr(10) ORDER BY i) AS s, span > 0 AND bool_or(regexp_matches(s, '[0-9]')) AS own FROM spans GROUP BY doc_id, lang, span),
        placed AS (SELECT *, greatest(count(*) FILTER (own) OVER (PARTITION BY doc_id ORDER BY span) - 1, 0) AS part FROM pieces),
        fragments AS (SELECT doc_id, lang, part, regexp_replace(string_agg(s, chr(10) ORDER BY span), '^\s+|\s+$', '', 'g') AS f FROM placed GROUP BY doc_id, lang, part)
        SELECT lang, part = 0 AS kept, count(*) AS n, max(part)::INT AS last_place, sum(length(f))::BIGINT AS chars FROM fragments GROUP BY 1, 2""",
    "law_inventory": f"WITH {_INVENTORY} SELECT basis, verified, count(*) AS n, count(effective) AS n_dated, sum(n_claims)::BIGINT AS n_claims, min(effective) AS first, max(effective) AS last FROM inv GROUP BY 1, 2",
    "law_prices": f"""WITH {_INVENTORY}
        SELECT day::DATE AS day, priority, count(*) AS n, sum(round(total * 100)::BIGINT)::BIGINT AS cents, coalesce(sum(round(total * 100)::BIGINT) FILTER (basis = 'inferred'), 0)::BIGINT AS inferred_cents
        FROM inv, range(DATE '2024-02-01', DATE '2024-06-02', INTERVAL 1 MONTH) AS r(day) WHERE effective <= day - INTERVAL 1 DAY GROUP BY 1, 2""",
    "candidate_places": r"""
        WITH o AS (SELECT year(o_orderdate) AS y, o_custkey AS c, substr(o_orderpriority, 3, 1) AS s FROM orders),
        cases AS (SELECT DISTINCT y || '-' || lpad(c::VARCHAR, 9, '0') AS stem, s, y || '-' || c || ' ' || s AS raw FROM o),
        variants AS (SELECT stem || s AS key, stem || s AS v FROM cases UNION SELECT stem || s, raw FROM cases UNION SELECT stem || s, stem FROM cases UNION SELECT a.stem || a.s, a.stem || b.s FROM cases a JOIN cases b USING (stem)),
        lows AS (SELECT key, v FROM variants UNION SELECT key, regexp_replace(v, '[A-Z]+$', '') || lower(regexp_extract(v, '[A-Z]+$')) FROM variants),
        numbers AS (SELECT DISTINCT l_partkey::VARCHAR AS key, l_returnflag = 'R' AS r, year(l_shipdate) AS y FROM lineitem WHERE length(l_partkey::VARCHAR) BETWEEN 3 AND 6),
        forms AS (SELECT DISTINCT key, unnest(CASE WHEN r THEN [key, 'R' || key] ELSE [key] END) AS v, y FROM numbers),
        places AS (SELECT 'packets' AS family, key, v, 'packets/' || v || '.pdf' AS p FROM variants UNION ALL SELECT 'archive', key, v, 'archive/' || v || '.pdf' FROM lows
            UNION ALL SELECT DISTINCT 'motions', key, v, 'motions/' || (y + k) || '/' || v || '.pdf' FROM forms, unnest([-1, 0, 1]) AS u(k))
        SELECT family, count(*) AS n, count(DISTINCT key) AS n_keys, count(DISTINCT v) AS n_variants, sum(length(p))::BIGINT AS chars, max(p) AS last_place FROM places GROUP BY 1""",
    "dates_of_blocks": """
        WITH marks AS (SELECT client_id AS doc, epoch_us(date_trunc('second', sold_at)) AS place, max(sold_at::DATE) AS day FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY 1, 2),
        firsts AS (SELECT doc, arg_min(day, place) AS day FROM marks GROUP BY 1),
        blocks AS (SELECT DISTINCT ON (client_id, click_id) client_id AS doc, click_id, epoch_us(date_trunc('second', ts)) AS place, coalesce(kind, '') AS kind, arrived_at::DATE AS arrived FROM clicks WHERE client_id IS NOT NULL AND click_id IS NOT NULL ORDER BY client_id, click_id, ts NULLS FIRST, clicks.kind NULLS FIRST, arrived_at NULLS FIRST),
        near AS (SELECT b.*, CASE WHEN b.place IS NOT NULL THEN coalesce(m.day, f.day) END AS day FROM blocks b ASOF LEFT JOIN marks m ON b.doc = m.doc AND b.place >= m.place LEFT JOIN firsts f ON b.doc = f.doc),
        wanted AS (SELECT kind, arrived, coalesce(day, last_value(day IGNORE NULLS) OVER (PARTITION BY doc ORDER BY click_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS want FROM near)
        SELECT kind, count(*) AS n, count(want) AS n_dated, count(*) FILTER (arrived = want) AS n_same, max(want)::VARCHAR AS last FROM wanted GROUP BY 1""",
}
