"""Printed records: keys, permits, measures, clauses, registers and items written out from the tables' columns and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import keys as K
from panelspark.functions import parsing as P
from panelspark.session import spread, table


def _said(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def permits_by_form(spark: SparkSession, d: str) -> DataFrame:
    """Permit numbers printed in four forms, with impostors after "No.": numbers found by form."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    serial = F.lpad((k % 9000 + 1000).cast("string"), 4, "0")
    dotted = _said("Building permit application ", F.date_format(day, "yyyy.MM.dd"), ".", serial)
    short = _said("permits ", F.date_format(day, "yyyy.MMdd"), "/", serial, " and again ", F.date_format(day, "yyyy.MMdd"), ".", serial)
    packed = _said("see ", F.date_format(day, "yyyyMMdd"), serial)
    bare = _said(F.when(k % 2 == 0, "demolition permit").otherwise("notice of violation on a permit"), " No. ", k + 8000000)
    text = F.when(k % 4 == 0, dotted).when(k % 4 == 1, short).when(k % 4 == 2, packed).otherwise(bare)
    found = o.select("o_orderkey", F.explode(P.permit_numbers(text)).alias("p")).select("o_orderkey", "p.*")
    return found.groupBy("form").agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("most"), F.countDistinct("o_orderkey").alias("n_orders"))


def long_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Runs of eight digits and more in a list of references, distinct."""
    k = F.col("o_orderkey")
    text = _said("A-", k, ", ", k + 10000000, "; ", k + 10000000, " / x", k + 20000000, " (", k + 300000000, ")")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(P.permits_from(text), ";").alias("numbers"))


def typed_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of conditions, each read from conditions of its kind alone."""
    k, s = F.col("p_partkey"), F.col("p_size")
    heading = F.element_at(F.array(*[F.lit(h) for h in ("Validity", "Bicycle Parking", "Affordable Units", "Notification", "Monitoring Report", "Hours of Operation")]), (k % 6 + 1).cast("int"))
    body = F.element_at(
        F.array(
            _said("This approval is valid for ", s, " months from the date."),
            _said("Provide ", s, " Class 1 bicycle spaces and two Class 2 bicycle spaces within 300 feet."),
            _said("Of the ", k, " dwelling units, 12.5 percent shall be affordable at 55% of the area median income."),
            _said("Mail to owners within ", s * 10, " feet at least thirty (30) days before."),
            F.lit("A report shall be filed quarterly with the Department."),
            _said("The use may be open from ", s % 11 + 1, ":30 am to 1 am."),
        ),
        (k % 6 + 1).cast("int"),
    )
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", P.numbers_of(heading, body).alias("m")).select("p_partkey", "m.*")


_OPENERS, _REQUEST, _CLOSING, _HEADER = r"(?i)\b(?:appeal of|consideration of|informational presentation)\b", r"(?i)\brequest for\b", r"(?i)preliminary recommendation", r"lots? \d+ in block \d+[;,.]"


def described_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Where the description of an item begins: the leftmost opening phrase before the closing block, else what follows the header."""
    k = F.col("p_partkey")
    text = F.element_at(
        F.array(
            _said("100 Main, lot ", k, " in block 12; Request for Conditional Use to build ", k, " units. Then more. Preliminary Recommendation: Consideration of it."),
            _said("Appeal of permit ", k, " by neighbours. Request for Review."),
            _said("Lot ", k, " in block 7. A building of ", k, " units on the north side of the long street. Preliminary recommendation."),
            _said("Nothing here but ", k),
        ),
        (k % 4 + 1).cast("int"),
    )
    return table(spark, d, "part").select("p_partkey", P.description_clause(text, _OPENERS, _REQUEST, _CLOSING, r"(?i)" + _HEADER).alias("c")).select("p_partkey", "c.*")


def fee_register(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of a register under the section last named above them."""
    p = table(spark, d, "part").select("p_partkey", _said("SECTION ", F.col("p_size"), " fees\nbase fee $", F.col("p_partkey"), ".50 a foot\nno amount\nSECTION B\nsurcharge $1,", F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("text"))
    return P.fee_lines(p, "p_partkey", "text", r"^SECTION ")


def height_districts(spark: SparkSession, d: str) -> DataFrame:
    """Base height, second height and bulk letter of printed districts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 3 == 0, _said(s, "-x")).when(k % 3 == 1, _said(s, "/", s + 20, "-J")).otherwise(F.lit("OS"))
    return table(spark, d, "part").select("p_partkey", P.height_parts(text).alias("h")).select("p_partkey", "h.*")


def numbered_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut where a numbered item begins on a line of its own."""
    p = table(spark, d, "part").select("p_partkey", _said("Roll call\n1. First of ", F.col("p_size"), "\nstill 2. not an item\n2. Second\n10. Tenth ", F.col("p_partkey")).alias("text"))
    i = P.split_items(p, "p_partkey", "text")
    return i.groupBy("item").agg(F.count("*").alias("n"), F.min(F.length("body")).alias("shortest"), F.max(F.length("body")).alias("longest"))


def learned_renumbering(spark: SparkSession, d: str) -> DataFrame:
    """New section numbers learned from "(formerly ...)", by majority."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = _said("Under Section ", F.when(k % 5 == 0, s + 1).otherwise(s + 100), ".2 (formerly Section ", s, ") and Section 9 (formerly 8.1).")
    return P.renumbering(table(spark, d, "part").select(text.alias("text")), "text")


def claimed_values(spark: SparkSession, d: str) -> DataFrame:
    """The first value of each field that a text claims, with the words that claim it."""
    k = F.col("p_partkey")
    text = _said("Effective January 1, ", k % 30 + 1990, ", a fee of $", k, " applies", F.when(k % 2 == 0, " within 300 feet").otherwise(""), ".")
    c = table(spark, d, "part").select(F.explode(P.claims(text, {"effective": r"[Ee]ffective ([A-Z][a-z]+ \d{1,2}, \d{4})", "fee": r"fee of \$(\d+)", "radius": r"within (\d+) feet"})).alias("c")).select("c.*")
    return c.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max("quote").alias("last_quote"))


def mapped_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Terms of one vocabulary in another's, unknown ones flagged for review."""
    term = F.element_at(F.array(F.lit("Conditional  Use"), F.lit("VARIANCE "), F.lit("Zoning Change"), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    m = table(spark, d, "customer").select(P.mapped(term, {"conditional use": "cu", "variance": "var"}).alias("m")).select("m.*")
    return m.groupBy("value", "review").agg(F.count("*").alias("n"))


def printed_case_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every printed form of a case, and how many distinct ones the table's cases have together."""
    c = table(spark, d, "customer").select(P.case_variants(F.lit(1990) + F.col("c_custkey") % 20, F.col("c_custkey"), ["A", "CUA"]).alias("v"))
    return c.select(F.explode("v").alias("v")).groupBy(F.length("v").alias("length")).agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_distinct"), F.min("v").alias("least"))


def band_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Lower bounds of printed bands."""
    k = F.col("p_size")
    text = F.when(k % 4 == 0, _said("> ", k)).when(k % 4 == 1, _said(k, "-", k + 10)).when(k % 4 == 2, _said(k, "+")).otherwise(F.lit("any"))
    return table(spark, d, "part").groupBy(P.bands(text).alias("bound")).agg(F.count("*").alias("n"))


def reduced_names(spark: SparkSession, d: str) -> DataFrame:
    """Names reduced to surnames, with the initial where two people share one."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "Commissioner Ann Lee").when(k % 5 == 1, "Mr. Bob Lee (absent)").when(k % 5 == 2, "Lee").when(k % 5 == 3, "Dr. Cy Wu, Jr.").otherwise("Wu")
    return P.name_reducer(table(spark, d, "customer").select(name.alias("name")), "name").withColumn("n", F.lit(1))


def addresses_and_names(spark: SparkSession, d: str) -> DataFrame:
    """Addresses up to their gloss, names without honorifics but with their marker, and lots of a list."""
    k = F.col("p_partkey")
    address = F.when(k % 4 == 0, _said(k, " North Point Street, north side between Polk and Larkin")).when(k % 4 == 1, _said(k, " West Portal Avenue ")).when(k % 4 == 2, _said(k, " Main St at the corner of 2nd")).otherwise(_said(k, " Pine (aka 2 Oak);"))
    person = F.when(k % 2 == 0, "(M) Mr. John  Q Public (sponsor)").otherwise("Commissioner Jane Roe.")
    lots = _said("O", k % 50 + 1, ", ", k % 9 + 1, "a and 12B/", k % 9 + 1, "A")
    return table(spark, d, "part").select("p_partkey", K.address_core(address).alias("address"), K.clean_name(person).alias("person"), F.array_join(K.lot_list(lots), ";").alias("lots"))


def read_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of laid-out texts: running headers and page numbers away, numbered and capital starts, confidence by sequence."""
    head = "CASE NO. 7\n"
    p = table(spark, d, "part").select("p_partkey", _said(head, "1. Validity. It holds\nfor ", F.col("p_size"), " years.\n", head, "12\n2. Parking. None.\n", head, "GENERAL\nAll else.\n5. Late. Last ", F.col("p_partkey")).alias("text"))
    c = P.condition_starts(p, "p_partkey", "text")
    return c.groupBy("ordinal", "number", "heading", "method", "confidence").agg(F.count("*").alias("n"), F.min("body").alias("least_body"), F.max("body").alias("most_body"))


QUERIES = {f.__name__: f for f in (permits_by_form, long_numbers, typed_measures, described_clauses, fee_register, height_districts, numbered_items, learned_renumbering, claimed_values, mapped_vocabulary, printed_case_forms, band_bounds, reduced_names, addresses_and_names, read_conditions)}

ORACLE_SQL = {
    "permits_by_form": """
        WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 9000 + 1000)::VARCHAR, 4, '0') AS n FROM orders),
        f AS (SELECT k, CASE k % 4 WHEN 0 THEN 'YYYY.MM.DD.NNNN' WHEN 1 THEN 'YYYY.MMDD.NNNN' WHEN 2 THEN 'packed' ELSE 'seven-digit' END AS form, CASE WHEN k % 4 = 3 THEN (k + 8000000)::VARCHAR ELSE n END AS number FROM o WHERE NOT (k % 4 = 3 AND k % 2 = 1))
        SELECT form, count(*) AS n, min(number) AS least, max(number) AS most, count(DISTINCT k) AS n_orders FROM f GROUP BY 1""",
    "long_numbers": "SELECT o_orderkey, (o_orderkey + 10000000) || ';' || (o_orderkey + 300000000) AS numbers FROM orders",
    "typed_measures": """
        SELECT p_partkey, CASE WHEN k = 0 THEN s END::DOUBLE AS validity_months, CASE WHEN k = 5 THEN s % 11 + 1.5 END::DOUBLE AS hours_open, CASE WHEN k = 5 THEN 25 END::DOUBLE AS hours_close, CASE WHEN k = 1 THEN s END::DOUBLE AS bike_class1, CASE WHEN k = 1 THEN 2 END::DOUBLE AS bike_class2,
               NULL::DOUBLE AS parking_max, CASE WHEN k = 2 THEN 12.5 END::DOUBLE AS affordable_pct, CASE WHEN k = 2 THEN p_partkey END::DOUBLE AS units_total, CASE WHEN k = 2 THEN 55 END::DOUBLE AS income_pct, NULL::DOUBLE AS screen_ft,
               CASE WHEN k = 3 THEN s * 10 END::DOUBLE AS notice_radius_ft, CASE WHEN k = 3 THEN 30 END::DOUBLE AS notice_days, CASE WHEN k = 4 THEN 3 END::DOUBLE AS monitor_months
        FROM (SELECT p_partkey, p_size AS s, p_partkey % 6 AS k FROM part)""",
    "described_clauses": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Request for Conditional Use to build ' || p_partkey || ' units' WHEN 1 THEN 'Appeal of permit ' || p_partkey || ' by neighbours' WHEN 2 THEN 'A building of ' || p_partkey || ' units on the north side of the long street' ELSE '' END AS text,
               CASE p_partkey % 4 WHEN 0 THEN 'request_for' WHEN 1 THEN 'opener' WHEN 2 THEN 'after_header' ELSE 'none' END AS rule FROM part""",
    "fee_register": """
        SELECT p_partkey, 1 AS line, 'SECTION ' || p_size || ' fees' AS section, p_partkey + 0.5::DOUBLE AS rate FROM part UNION ALL SELECT p_partkey, 4, 'SECTION B', 1000.0::DOUBLE + p_partkey % 1000 FROM part""",
    "height_districts": """
        SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS base, CASE WHEN p_partkey % 3 = 1 THEN p_size + 20 END AS second, CASE p_partkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'J' END AS bulk FROM part""",
    "numbered_items": """
        WITH i AS (SELECT unnest([{'i': 0, 'b': 'Roll call'}, {'i': 1, 'b': '1. First of ' || p_size || chr(10) || 'still 2. not an item'}, {'i': 2, 'b': '2. Second'}, {'i': 3, 'b': '10. Tenth ' || p_partkey}], recursive := true) FROM part)
        SELECT i AS item, count(*) AS n, min(length(b)) AS shortest, max(length(b)) AS longest FROM i GROUP BY 1""",
    "learned_renumbering": """
        WITH s AS (SELECT p_size::VARCHAR AS old, (CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size + 100 END) || '.2' AS new FROM part UNION ALL SELECT '8.1', '9' FROM part),
        c AS (SELECT old, new, count(*) AS n FROM s GROUP BY 1, 2) SELECT old, new, n FROM c QUALIFY row_number() OVER (PARTITION BY old ORDER BY n DESC, new) = 1""",
    "claimed_values": """
        SELECT 'effective' AS field, count(*) AS n, count(DISTINCT p_partkey % 30) AS n_values, max('Effective January 1, ' || (p_partkey % 30 + 1990)) AS last_quote FROM part
        UNION ALL SELECT 'fee', count(*), count(DISTINCT p_partkey), max('fee of $' || p_partkey) FROM part UNION ALL SELECT 'radius', count(*), 1, 'within 300 feet' FROM part WHERE p_partkey % 2 = 0""",
    "mapped_vocabulary": "SELECT CASE c_custkey % 4 WHEN 0 THEN 'cu' WHEN 1 THEN 'var' END AS value, c_custkey % 4 = 2 AS review, count(*) AS n FROM customer GROUP BY 1, 2",
    "printed_case_forms": """
        WITH c AS (SELECT c_custkey::VARCHAR AS s, (1990 + c_custkey % 20)::VARCHAR AS y FROM customer), v AS (SELECT DISTINCT s, unnest([y, y[3:4]]) AS y, unnest([y, y]) AS yy FROM c),
        w AS (SELECT DISTINCT c.s AS id, a.y || '-' || b.n || e.e AS v FROM c, (SELECT s, unnest([y, y[3:4]]) AS y FROM c) a, (SELECT s, unnest([s, CASE WHEN length(s) < 6 THEN lpad(s, 6, '0') ELSE s END]) AS n FROM c) b, (VALUES (''), ('A'), ('CUA')) e(e) WHERE a.s = c.s AND b.s = c.s)
        SELECT length(v)::INT AS length, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS least FROM w GROUP BY 1""",
    "band_bounds": "SELECT CASE p_size % 4 WHEN 0 THEN p_size + 1 WHEN 3 THEN NULL ELSE p_size END AS bound, count(*) AS n FROM part GROUP BY 1",
    "reduced_names": """
        SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'Commissioner Ann Lee' WHEN 1 THEN 'Mr. Bob Lee (absent)' WHEN 2 THEN 'Lee' WHEN 3 THEN 'Dr. Cy Wu, Jr.' ELSE 'Wu' END AS name,
               CASE c_custkey % 5 WHEN 0 THEN 'a lee' WHEN 1 THEN 'b lee' WHEN 2 THEN 'lee' ELSE 'wu' END AS reduced, 1 AS n FROM customer""",
    "addresses_and_names": """
        SELECT p_partkey, p_partkey || CASE p_partkey % 4 WHEN 0 THEN ' North Point Street' WHEN 1 THEN ' West Portal Avenue' WHEN 2 THEN ' Main St' ELSE ' Pine' END AS address,
               CASE WHEN p_partkey % 2 = 0 THEN '(M) John Q. Public' ELSE 'Jane Roe' END AS person, array_to_string(list_distinct_in_order, ';') AS lots
        FROM (SELECT p_partkey, CASE WHEN x = y THEN [x, '12B'] ELSE [x, y, '12B'] END AS list_distinct_in_order FROM (SELECT p_partkey, (p_partkey % 50 + 1)::VARCHAR AS x, (p_partkey % 9 + 1) || 'A' AS y FROM part))""",
    "read_conditions": """
        SELECT 1 AS ordinal, 1 AS number, 'Validity' AS heading, 'numbered' AS method, 'high' AS confidence, count(*) AS n, min('It holds for ' || p_size || ' years.') AS least_body, max('It holds for ' || p_size || ' years.') AS most_body FROM part
        UNION ALL SELECT 2, 2, 'Parking', 'numbered', 'high', count(*), 'None.', 'None.' FROM part UNION ALL SELECT 3, NULL, 'GENERAL', 'caps', 'low', count(*), 'All else.', 'All else.' FROM part
        UNION ALL SELECT 4, 5, 'Late', 'numbered', 'low', count(*), min('Last ' || p_partkey), max('Last ' || p_partkey) FROM part""",
}
