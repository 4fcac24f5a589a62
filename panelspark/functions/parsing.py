"""Parsers of printed records as Column -> Column: permit numbers, typed measures, clauses, registers, items, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.functions import textops as T

#: Printed forms of a permit number, the more particular first: name and pattern, whose digits are the number.
PERMIT_FORMS = (
    ("YYYY.MM.DD.NNNN", r"\b((?:19|20)\d\d)[.\-/](\d{2})[.\-/](\d{2})[.\-/](\d{3,5})\b"),
    ("YYYY.MMDD.NNNN", r"\b((?:19|20)\d\d)[.\-/](\d{4})[.\-/](\d{3,5})\b"),
    ("packed", r"\b((?:19|20)\d\d)(\d{2})(\d{2})(\d{4})\b"),
)
#: A bare number after "No." counts where the 70 characters before speak of a permit and of nothing that also has such numbers.
BARE, RUN_UP = r"\bNos?\.?\s*(\d{7,9})\b", 70
BARE_OK, BARE_BAD = r"(?i)\bpermits?\b|\bBPA\b", r"(?i)notice of violation|\bNOV\b|complaint|clearinghouse|enforcement"


def permit_numbers(text: Column) -> Column:
    """array<struct<number, form>>: every permit number as digits with the printed form that claims it first."""
    text = F.coalesce(text, F.lit(""))
    found = []
    claim = lambda name: lambda m: F.struct(F.regexp_replace(m, r"\D+", "").alias("number"), F.lit(name).alias("form"))
    for name, rx in PERMIT_FORMS:
        found.append(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), claim(name)))
    # The numbers first, then what stands before each in the whole text, other numbers included: a fold that keeps the last RUN_UP characters.
    bare, between = F.regexp_extract_all(text, F.lit(BARE), F.lit(0)), F.split(text, BARE, -1)
    state = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<said:string,before:string>>").alias("seen"))

    def step(s: Column, m: Column) -> Column:
        before = F.right(F.concat(s["tail"], m["gap"]), F.lit(RUN_UP))
        one = F.struct(m["said"].alias("said"), before.alias("before"))
        return F.struct(F.right(F.concat(before, m["said"]), F.lit(RUN_UP)).alias("tail"), F.concat(s["seen"], F.array(one)).alias("seen"))

    pairs = F.zip_with(bare, F.slice(between, 1, F.size(bare)), lambda m, gap: F.struct(m.alias("said"), gap.alias("gap")))
    kept = F.filter(F.aggregate(pairs, state, step)["seen"], lambda m: m["before"].rlike(BARE_OK) & ~m["before"].rlike(BARE_BAD))
    found.append(F.transform(kept, lambda m: F.struct(F.regexp_extract(m["said"], r"(\d{7,9})$", 1).alias("number"), F.lit("seven-digit").alias("form"))))
    every = F.concat(*found)
    numbers = F.array_distinct(F.transform(every, lambda x: x["number"]))
    return F.transform(numbers, lambda n: F.filter(every, lambda x: x["number"] == n)[0])


def permits_from(text: Column) -> Column:
    """array<string>: runs of digits of at least eight, in a text cut at what is neither letter nor digit."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^\d{8,}$")))


def _counted(text: Column) -> Column:
    """A printed count, in digits or words, as a number; else null."""
    words = F.create_map(*[F.lit(v) for p in T.NUMBER_WORDS.items() for v in p])
    return T.bound(F.lower(F.regexp_replace(text, ",", "")), lambda got: F.coalesce(got.try_cast("double"), F.try_element_at(words, F.nullif(got, F.lit(""))).cast("double")))


def _all_numbers(text: Column, rx: str, group: int = 1) -> Column:
    """The sum of a group of all of a pattern's matches; null where none is a number."""
    found = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(group)), _counted))
    return T.bound(found, lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda a, b: a + b)))


def _first_number(text: Column, rx: str, group: int = 1) -> Column:
    """The group of a pattern's first match as a number, by digits or number words; else null."""
    return _counted(F.regexp_extract(text, rx, group))


_COUNT = r"(\d[\d,]*|" + "|".join(T.NUMBER_WORDS) + r")(?:\s*\(\d+\))?"
#: Months of an interval in words.
INTERVALS = {"month": 1.0, "monthly": 1.0, "quarterly": 3.0, "semi-annually": 6.0, "six months": 6.0, "annually": 12.0, "annual": 12.0, "year": 12.0, "every year": 12.0}


def numbers_of(heading: Column, body: Column) -> Column:
    """struct of typed measures of a condition, each read only from conditions of its kind, by heading or first words."""
    h, b = F.lower(F.coalesce(heading, F.lit(""))), F.coalesce(body, F.lit(""))
    lead = lambda v: F.concat_ws(" ", v["h"], F.lower(F.substring(v["b"], 1, 200)))
    return T.bound(F.struct(h.alias("h"), b.alias("b")), lambda v: T.bound(lead(v), lambda l: _measures(v["h"], v["b"], l)))


def _measures(h: Column, b: Column, lead: Column) -> Column:
    about = lambda rx, text=lead: text.rlike(rx)
    start, end = T.hours(b)
    hours = about(r"hours of operation|operating hours|shall be (?:open|closed)|limited to the following hours")
    bikes = lambda cls: F.when(about("bicycle"), _all_numbers(b, rf"(?i){_COUNT}\s+class\s+(?:{cls})\s+(?:bicycle|bike)"))
    interval = F.create_map(*[F.lit(v) for p in INTERVALS.items() for v in p])
    values = {
        "validity_months": F.when(about(r"valid|expir"), F.get(T.durations(b), 0)),
        "hours_open": F.when(hours, start),
        "hours_close": F.when(hours, end),
        "bike_class1": bikes("1|i"),
        "bike_class2": bikes("2|ii"),
        "parking_max": F.when(about("parking"), _first_number(b, rf"(?i)no more than\s+{_COUNT}\s+(?:off-street\s+)?parking")),
        "affordable_pct": F.when(about(r"affordable|inclusionary|below market"), _first_number(b, r"(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)")),
        "units_total": F.when(about(r"affordable|inclusionary|below market"), _first_number(b, r"(?i)of the\s+([\d,]+)\s+(?:dwelling\s+)?units")),
        "income_pct": F.when(about(r"affordable|inclusionary|below market"), _first_number(b, r"(?i)(\d+)\s*(?:%|percent) of (?:the )?area median")),
        "screen_ft": F.when(about("screen", h) & ~F.lower(F.substring(b, 1, 300)).contains("fcc"), _first_number(b, rf"(?i){_COUNT}\s*(?:feet|foot|ft)")),
        "notice_radius_ft": F.when(about(r"notif|notice|posted"), _first_number(b, rf"(?i)within\s+{_COUNT}\s*(?:feet|foot|ft)")),
        "notice_days": F.when(about(r"notif|notice|posted"), _first_number(b, rf"(?i){_COUNT}\s+(?:calendar\s+|business\s+)?days")),
        "monitor_months": F.when(about(r"monitor|report|periodic|certif", h), F.try_element_at(interval, F.nullif(F.lower(F.regexp_extract(b, r"(?i)\b(monthly|quarterly|semi-annually|every year|annually|annual|six months)\b", 1)), F.lit("")))),
    }
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def description_clause(block: Column, openers: str, request: str, closing: str, header: str) -> Column:
    """struct<text, rule>: from the leftmost of two opening patterns before the closing block to the end of its clause, else what follows the last header where that is 40 characters or more, else blank."""
    text = F.regexp_replace(F.coalesce(block, F.lit("")), r"[ \t]*\n[ \t]*", " ")
    stop = F.regexp_instr(text, F.lit(closing))
    head = F.when(stop > 0, F.substring(text, F.lit(1), stop - 1)).otherwise(text)
    rf, op = F.regexp_instr(head, F.lit(request)), F.regexp_instr(head, F.lit(openers))
    clause = lambda at: F.trim(F.regexp_extract(F.substring(text, at, F.length(text)), r"^(.*?)(?:\.\s|\.$|$)", 1))
    tail = clause(F.length(F.regexp_extract(head, rf"(?s)^(.*(?:{header}))", 1)) + 1)
    by_request = (rf > 0) & ((op == 0) | (rf <= op))
    after = head.rlike(header) & (F.length(tail) >= 40)
    text_of = F.when(by_request, clause(rf)).when(op > 0, clause(op)).when(after, tail).otherwise("")
    rule = F.when(by_request, "request_for").when(op > 0, "opener").when(after, "after_header").otherwise("none")
    return F.struct(text_of.alias("text"), rule.alias("rule"))


def height_parts(x: Column) -> Column:
    """struct<base, second, bulk> of a printed district: 40-X, 65/85-J, 130-E; null where it doesn't read so."""
    rx = r"^\s*(\d+)(?:\s*/\s*(\d+))?\s*-?\s*([A-Z])?"
    part = lambda g: F.nullif(F.regexp_extract(F.upper(x), rx, g), F.lit(""))
    return F.struct(part(1).try_cast("int").alias("base"), part(2).try_cast("int").alias("second"), part(3).alias("bulk"))


def fee_lines(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, line, section, rate): lines of a register with an amount, under the last line that the marker names: a label is carried forward to the lines below it."""
    lines = df.select(key, F.posexplode(F.split(text, r"\n")).alias("line", "said"))
    label = F.when(F.col("said").rlike(marker), F.trim("said"))
    section = F.last(label, ignorenulls=True).over(W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    rate = F.regexp_replace(F.regexp_extract("said", r"\$\s?([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    return lines.withColumn("section", section).withColumn("rate", rate).where("rate is not null").select(key, "line", "section", "rate")


def split_items(df: DataFrame, key: str, text: str, start: str = r"\n(?=\d{1,2}\. )") -> DataFrame:
    """(key, item, body): the text cut before lines that begin an item; what stands before the first one is item 0."""
    return df.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), start)).alias("item", "body")).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where("body <> ''")


def renumbering(df: DataFrame, text: str, rx: str = r"[Ss]ection (\d+(?:\.\d+)*) \(formerly (?:[Ss]ection )?(\d+(?:\.\d+)*)\)") -> DataFrame:
    """(old, new, n): the new number that most texts give an old one, learned from "(formerly ...)"; the smaller of ties."""
    said = df.select(F.explode(F.regexp_extract_all(text, F.lit(rx), F.lit(0))).alias("m")).select(F.regexp_extract("m", rx, 2).alias("old"), F.regexp_extract("m", rx, 1).alias("new"))
    return said.groupBy("old", "new").agg(F.count("*").alias("n")).groupBy("old").agg(F.min_by(F.struct("new", "n"), F.struct(-F.col("n"), F.col("new"))).alias("b")).select("old", "b.new", "b.n")


def claims(text: Column, patterns: dict[str, str]) -> Column:
    """array<struct<field, value, quote>>: the first match of each field's pattern, its value in group 1."""
    one = lambda f, rx: F.when(text.rlike(rx), F.struct(F.lit(f).alias("field"), F.regexp_extract(text, rx, 1).alias("value"), F.regexp_extract(text, rx, 0).alias("quote")))
    return F.array_compact(F.array(*[one(f, rx) for f, rx in patterns.items()]))


def mapped(x: Column, vocabulary: dict[str, str]) -> Column:
    """struct<value, review>: the term's mapping, case and space aside; unknown terms are null and flagged."""
    table = F.create_map(*[F.lit(v) for p in vocabulary.items() for v in p])
    value = F.try_element_at(table, F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.struct(value.alias("value"), (value.isNull() & x.isNotNull()).alias("review"))


def case_variants(stem_year: Column, serial: Column, suffixes: list[str]) -> Column:
    """array<string>: every printed form of a case: two- and four-digit years, padded and plain serials, with each suffix and without."""
    years = F.array(stem_year.cast("string"), F.substring(stem_year.cast("string"), 3, 2))
    serials = F.array(serial.cast("string"), F.when(F.length(serial.cast("string")) < 6, F.lpad(serial.cast("string"), 6, "0")).otherwise(serial.cast("string")))
    ends = F.array(F.lit(""), *[F.lit(s) for s in suffixes])
    made = F.flatten(F.transform(years, lambda y: F.flatten(F.transform(serials, lambda n: F.transform(ends, lambda e: F.concat(y, F.lit("-"), n, e))))))
    return F.array_sort(F.array_distinct(made))


def bands(x: Column) -> Column:
    """Lower bound of a printed band: "1-20" and "21 to 99" their first number, "> 99" one more, "99+" itself."""
    first = F.regexp_extract(x, r"(\d+)", 1).try_cast("int")
    return F.when(x.rlike(r"^\s*>\s*\d"), first + 1).otherwise(first)


def ladder_of(x: Column, table: tuple) -> Column:
    """The label of the first pattern that a text holds, null where none does."""
    return reduce(lambda acc, r: F.when(F.coalesce(x.rlike(r[0]), F.lit(False)), F.lit(r[1])).otherwise(acc), reversed(table), F.lit(None).cast("string"))


def name_reducer(df: DataFrame, name: str) -> DataFrame:
    """(name, reduced): the surname alone, but with the initial of the given name where at least two initials of that surname are each printed twice."""
    from panelspark.functions import keys as K

    said = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    parts = said.withColumn("surname", K.surname(F.col("name"))).withColumn("initial", F.lower(F.regexp_extract(K.clean_name(F.col("name")), r"^(?:\([MF]\)\s*)?([A-Za-z])[A-Za-z.]*\s", 1)))
    evidence = parts.where("initial <> ''").groupBy("surname", "initial").agg(F.sum("n").alias("n")).where("n >= 2").groupBy("surname").agg(F.count("*").alias("initials")).where("initials >= 2")
    out = parts.join(evidence, "surname", "left")
    return out.select("name", F.when(F.col("initials").isNotNull() & (F.col("initial") != ""), F.concat_ws(" ", "initial", "surname")).otherwise(F.col("surname")).alias("reduced"))


def condition_starts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, number, heading, body, method, confidence): conditions of a text by a state over its lines.

    Lines that stand in three or more places of one document (running headers) and bare page numbers go. A line that begins
    with a number, one more than the last or 1, starts a numbered condition; a line in capitals starts an unnumbered one.
    Lines below belong to the condition begun last. Confidence is high for numbers in sequence, else low.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n")).alias("line", "said")).withColumn("said", F.trim("said")).where("said <> ''")
    repeats = F.count("*").over(W.partitionBy(key, "said"))
    lines = lines.withColumn("__k", repeats).where("__k < 3").where(~F.col("said").rlike(r"^(?:Page )?\d{1,3}$")).drop("__k")
    order = W.partitionBy(key).orderBy("line")
    number = F.regexp_extract("said", r"^(\d{1,3})\.\s", 1).try_cast("int")
    lines = lines.withColumn("number", number).withColumn("caps", F.col("said").rlike(r"^[A-Z][A-Z ,/&-]{4,60}$"))
    before = F.last("number", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    lines = lines.withColumn("__before", before).withColumn("start", F.col("number").isNotNull() | F.col("caps"))
    lines = lines.withColumn("ordinal", F.count_if("start").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("ordinal > 0")
    first = F.struct("line", "said", "number", "__before")
    out = lines.groupBy(key, "ordinal").agg(F.min(first).alias("f"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("ls"))
    said = F.col("f.said")
    body = F.array_join(F.transform(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0))), lambda l: l["said"]), " ")
    heading = F.when(F.col("f.number").isNotNull(), F.regexp_extract(said, r"^\d{1,3}\.\s+([^.]{1,80})", 1)).otherwise(said)
    sequence = (F.col("f.number") == F.coalesce(F.col("f.__before"), F.lit(0)) + 1) | (F.col("f.number") == 1)
    rest = F.when(F.col("f.number").isNotNull(), F.regexp_extract(said, r"^\d{1,3}\.\s+[^.]{1,80}\.?\s*(.*)$", 1)).otherwise("")
    return out.select(key, F.col("ordinal").cast("int").alias("ordinal"), F.col("f.number").alias("number"), F.trim(heading).alias("heading"), F.trim(F.concat_ws(" ", F.nullif(rest, F.lit("")), F.nullif(body, F.lit("")))).alias("body"), F.when(F.col("f.number").isNotNull(), "numbered").otherwise("caps").alias("method"), F.when(sequence, "high").otherwise("low").alias("confidence"))
