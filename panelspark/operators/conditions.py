"""Conditions read from the printed lines of decision documents, and the records that sections make of them.

A document is a table of lines (key, page, line, said, bold); line ascends within a page. What a line is follows from
itself and from the last event before it, so sections, exhibits and headings are windows over a document's lines in order;
only whether a number goes on with the sequence needs the numbers taken before it, and is a fold over a section's
candidate numbers, never over its lines.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# How instruments, exhibits, letters and standing lines are printed.
TITLE = r"(?i)^(?:city\s+)?(?:planning commission\s+)?(?:draft\s+)?(motion|resolution)\s+no\.?\s*[:#]?\s*(\d{3,6}|x{3,})$"
EXHIBIT_A = r"(?i)^exhibit\s+a\s*[:.\-–—]?\s*(?:conditions\s+of\s+approval.*)?$|^conditions\s+of\s+approval\.?$"
EXHIBIT_NEXT = r"(?i)^exhibit\s+[b-z]\b"
LETTER_OPENS = r"(?i)^re\s*:\s*\S|^dear\s+\S.{0,120}[:,]$"
PAGE_NUMBER = r"(?i)^(?:page\s+)?(?:\d{1,3}|[ivx]{1,5})(?:\s+of\s+\d{1,3})?$"
CONDITIONS_PART = r"(?i)^conditions\s+of\s+approval,?\s+compliance"
COMPLIANCE = r"(?i)^for\s+information\s+about\s+compliance,?\s*(?:contact\s*)?"
CASE = r"(?i)\b(?:case|record|file)\s+(?:no\.?|number|#)\s*[:.]?\s*((?:19|20)?\d{2}[.\-]\d{3,6}[A-Z]{0,16})\b"
DRAFT = r"(?i)\bdraft\s+(?:motion|resolution)\b"
ADOPTED = r"(?i)\badopted\b[^.]{0,60}?\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"
NUMBERED, PAREN, LETTERED = r"^(\d{1,3})\s*[.)](?=\s|$|[A-Z])\s*", r"^\(\s*(\d{1,3})\s*\)\s*(?=\S)", r"^([A-Z])\s*[.)]\s+(?=\S)"

#: Pages that a line has to stand on, as a number and as a part of the document's, to be a running one.
RUNNING_PAGES, RUNNING_PART = 3, 0.5


def squeezed(said: Column) -> Column:
    """A line with single spaces for white space, and none at its ends. Single spaces stay where they are, so most lines are not built anew."""
    return F.trim(F.regexp_replace(said, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, line, said, bold) of texts: pages at form feeds, lines at line feeds; a text says nothing of bold, so it is null. Empty lines are left out."""
    pages = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f")).alias("page", "__p"))
    lines = pages.select("key", "page", F.posexplode(F.split("__p", r"\r?\n")).alias("line", "said"))
    return lines.withColumn("said", squeezed(F.col("said"))).where("said <> ''").withColumn("bold", F.lit(None).cast("boolean"))


def without_running(lines: DataFrame) -> DataFrame:
    """Lines less page numbers and running ones: those whose shape, digits aside, stands on RUNNING_PAGES pages and on RUNNING_PART of all."""
    shape = F.lower(F.regexp_replace("said", r"\d+", "#"))
    shaped = lines.withColumn("__shape", shape)
    pages = lines.groupBy("key").agg(F.countDistinct("page").alias("__pages"))
    on = shaped.groupBy("key", "__shape").agg(F.countDistinct("page").alias("__on")).where(F.col("__on") >= RUNNING_PAGES)
    # Title lines repeat as running heads; the first of a number is the title.
    known = shaped.join(on.join(pages, "key"), ["key", "__shape"], "left")
    first = F.row_number().over(W.partitionBy("key", "said").orderBy("page", "line"))
    titled = F.col("said").rlike(TITLE)
    kept = known.withColumn("__first", F.when(titled, first).otherwise(0))
    running = F.coalesce(F.col("__on") >= RUNNING_PART * F.col("__pages"), F.lit(False)) & ~(titled & (F.col("__first") == 1))
    return kept.where(~running & ~F.col("said").rlike(PAGE_NUMBER)).drop("__shape", "__pages", "__on", "__first")


def heading_line(said: Column) -> Column:
    """Whether a line heads a section: capitals, two letters at least, no sentence, no number before it."""
    letters, capitals = F.length(F.regexp_replace(said, r"[^A-Za-z]", "")), F.length(F.regexp_replace(said, r"[^A-Z]", ""))
    return (letters >= 2) & (capitals >= 0.9 * letters) & (F.length(said) <= 80) & ~said.rlike(r"[.;]$") & ~said.rlike(NUMBERED) & ~said.rlike(PAREN)


def sections(lines: DataFrame) -> DataFrame:
    """Lines with section (0 before any title), instrument, number, and exhibit: whether they lie in its Exhibit A.

    A title of another number opens a section, one of the same number does not. Exhibit A opens at its own heading and ends
    at another exhibit, at a letter, or with the section.
    """
    order = W.partitionBy("key").orderBy("page", "line")
    upto, before = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, -1)
    said = F.col("said")
    title = F.when(said.rlike(TITLE), F.concat_ws(" ", F.lower(F.regexp_extract(said, TITLE, 1)), F.lower(F.regexp_extract(said, TITLE, 2))))
    marked = lines.withColumn("__title", title)
    marked = marked.withColumn("__opens", F.col("__title").isNotNull() & ~F.col("__title").eqNullSafe(F.last("__title", ignorenulls=True).over(before)))
    placed = marked.withColumn("section", F.count_if("__opens").over(upto)).withColumn("__now", F.last("__title", ignorenulls=True).over(upto))
    event = F.when(F.col("__opens") | said.rlike(EXHIBIT_NEXT) | said.rlike(LETTER_OPENS), F.lit(False)).when(said.rlike(EXHIBIT_A), F.lit(True))
    within = W.partitionBy("key", "section").orderBy("page", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.withColumn("__event", event).withColumn("exhibit", F.coalesce(F.last("__event", ignorenulls=True).over(within), F.lit(False)) & F.col("__event").isNull())
    return inside.withColumn("instrument", F.nullif(F.split_part("__now", F.lit(" "), F.lit(1)), F.lit(""))).withColumn("number", F.nullif(F.split_part("__now", F.lit(" "), F.lit(2)), F.lit(""))).drop("__title", "__opens", "__now", "__event")


def taken(numbers: Column) -> Column:
    """Which of a section's candidate numbers, array<struct<place, n>> in order, begin conditions: array<struct<place, gap>>.

    A number goes on if it is the one expected, 1, one or two beyond, or up to five above the highest; any but the one
    expected and 1 leaves a gap. The rest are numbers of lists within a condition.
    """
    none = F.array().cast("array<struct<place:long,gap:boolean>>")
    state = F.struct(F.lit(1).alias("expected"), F.lit(0).alias("highest"), none.alias("taken"))

    def step(s: Column, c: Column) -> Column:
        n = c["n"]
        goes_on = (n == s["expected"]) | (n == 1) | ((n > s["expected"]) & (n <= s["expected"] + 2)) | ((n > s["highest"]) & (n <= s["highest"] + 5))
        gap = (n != s["expected"]) & (n != 1)
        one = F.struct(c["place"].cast("long").alias("place"), gap.alias("gap"))
        return F.when(goes_on, F.struct((n + 1).alias("expected"), F.greatest(s["highest"], n).alias("highest"), F.concat(s["taken"], F.array(one)).alias("taken"))).otherwise(s)

    return F.aggregate(numbers, state, step, lambda s: s["taken"])


def conditions(lines: DataFrame) -> DataFrame:
    """(key, section, ordinal, number, style, no, section_heading, heading, body, compliance_contact, part, page_start, page_end, sequence_gap, implicit, confidence).

    Lines of Exhibit A only. A section is numbered if 1, 2 and 3 begin lines of it, else by (1), (2), (3), else by A, B, C,
    else by bold names. A line in capitals heads a section; prose under it before any condition is a row of its own,
    implicit. A line "For information about compliance" and what follows it go to compliance_contact. Confidence is high
    for a name and an unbroken sequence, low for an implicit row or a gap without a name, else medium.
    """
    inside = sections(without_running(lines)).where("exhibit")
    own = W.partitionBy("key", "section")
    order = own.orderBy("page", "line")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    said = F.col("said")
    read = lambda rx: F.nullif(F.regexp_extract(said, rx, 1), F.lit(""))
    rows = inside.withColumn("__place", F.row_number().over(order)).withColumn("__num", read(NUMBERED).try_cast("int")).withColumn("__par", read(PAREN).try_cast("int")).withColumn("__let", read(LETTERED))
    has = lambda c, values: F.reduce(F.array(*[F.max((F.col(c) == v).cast("int")).over(own) for v in values]), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) == len(values)
    style = F.when(has("__num", (1, 2, 3)), "numbered").when(has("__par", (1, 2, 3)), "paren").when(has("__let", ("A", "B", "C")), "lettered").otherwise("bold_heading")
    rows = rows.withColumn("style", style)
    # The letter as its place in the alphabet, so that one fold serves all styles.
    n = F.when(F.col("style") == "numbered", F.col("__num")).when(F.col("style") == "paren", F.col("__par")).when(F.col("style") == "lettered", F.ascii("__let") - 64)
    rows = rows.withColumn("__n", n)
    candidates = rows.where("__n is not null").groupBy("key", "section").agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("place"), F.col("__n").alias("n")))).alias("c"))
    begun = candidates.select("key", "section", F.explode(taken(F.col("c"))).alias("t")).select("key", "section", F.col("t.place").cast("int").alias("__place"), F.col("t.gap").alias("__gap"))
    rows = rows.join(begun, ["key", "section", "__place"], "left")

    # Bold tells names from heads in the style without numbers; a head in capitals is a head in any.
    named = (F.col("style") == "bold_heading") & F.coalesce(F.col("bold"), F.lit(False)) & ~heading_line(said)
    part_line, compliance = said.rlike(CONDITIONS_PART), said.rlike(COMPLIANCE)
    head = heading_line(said) & F.col("__gap").isNull() & ~part_line & ~compliance
    what = F.when(part_line, "part").when(F.col("__gap").isNotNull() | named, "start").when(compliance, "compliance").when(head, "head").otherwise("prose")
    rows = rows.withColumn("__what", what)
    rows = rows.withColumn("part", F.when(F.max(part_line).over(own) & ~F.max(part_line).over(upto), "preamble").otherwise("conditions"))
    rows = rows.withColumn("section_heading", F.last(F.when(F.col("__what") == "head", said).when(F.col("__what") == "part", F.lit("")), ignorenulls=True).over(upto))
    # The last line that decides where prose goes: a head opens ground of its own until a condition starts.
    decides = F.last(F.when(F.col("__what").isin("start", "head", "part"), F.col("__what")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__under", F.coalesce(decides, F.lit("part")))
    opens = (F.col("__what") == "start") | ((F.col("__what") == "prose") & (F.col("__under") != "start") & (F.lag("__what", 1, "part").over(order) != "prose"))
    rows = rows.withColumn("ordinal", F.count_if(opens).over(upto)).where("__what in ('start', 'prose', 'compliance') and ordinal > 0")
    within = W.partitionBy("key", "section", "ordinal").orderBy("page", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__contact", F.max(F.col("__what") == "compliance").over(within))

    line = F.struct("page", "line", "said", "__what", "__gap", "bold", "__n", "style", "section_heading", "part", "number", "__let")
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page", "line", "said")))), lambda l: l["said"]), " ")
    out = rows.groupBy("key", "section", "ordinal").agg(F.min(line).alias("f"), text(~F.col("__contact")).alias("__body"), text(F.col("__contact")).alias("__compliance"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    started = F.col("f.__what") == "start"
    bare = F.when(started, F.regexp_replace("__body", f"{NUMBERED}|{PAREN}|{LETTERED}", "")).otherwise(F.col("__body"))
    # A name is a short run before the first full stop, its longer words capitalised.
    name = F.regexp_extract(bare, r"^([A-Z][^.]{1,80}?)\.(?:\s|$)", 1)
    plain = F.size(F.filter(F.split(name, r"\s+"), lambda w: (F.length(w) > 3) & w.rlike(r"^[a-z]"))) == 0
    heading = F.when(started & (name != "") & plain, name).otherwise("")
    body = F.when(heading != "", F.trim(F.expr("substring(__bare, length(__heading) + 2)"))).otherwise(F.col("__bare"))
    no = F.when(~started, F.lit(None)).when(F.col("f.style") == "lettered", F.col("f.__let")).otherwise(F.col("f.__n").cast("string"))
    gap = F.coalesce(F.col("f.__gap"), F.lit(False))
    confidence = F.when(~started | (gap & (heading == "")), "low").when((heading != "") & ~gap, "high").otherwise("medium")
    return out.withColumn("__bare", bare).withColumn("__heading", heading).select(
        "key", "section", "ordinal", F.col("f.number").alias("number"), F.col("f.style").alias("style"), no.alias("no"), F.coalesce("f.section_heading", F.lit("")).alias("section_heading"),
        heading.alias("heading"), body.alias("body"), F.trim(F.regexp_replace("__compliance", COMPLIANCE, "")).alias("compliance_contact"), F.col("f.part").alias("part"),
        "page_start", "page_end", gap.alias("sequence_gap"), (~started).alias("implicit"), confidence.alias("confidence"),
    )


def records(lines: DataFrame) -> DataFrame:
    """(key, section, record_key, key_source, instrument, number, case_number, adopted, draft, n_lines, n_conditions, canonical): one a section of every document.

    A record goes by its motion or resolution number, else by the case that its lines name first, else by the document's
    own key and section. Of several records of one record_key the canonical one is adopted rather than not, no draft, has
    most conditions, and comes from the smallest key and section.
    """
    return _ranked(_told(lines))


def records_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """The records of texts, as of their lines.

    What is a section, an exhibit or a running line takes lines in order only in a text with a title, a heading of Exhibit A
    or so many pages that one may run over them. Any other is one section without conditions, told where it stands. Of
    several such texts of one key a record takes the least case and date.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Words that every match of a pattern holds are looked for first.
    holds = lambda words: reduce(or_, [F.contains(F.lower("text"), F.lit(w)) for w in words.split("|")])
    said = F.filter(F.transform(F.split("text", r"\r?\n|\f"), squeezed), lambda s: s != "")
    heads = F.when(holds("motion|resolution|exhibit|conditions"), F.exists(said, lambda s: s.rlike(TITLE) | s.rlike(EXHIBIT_A))).otherwise(F.lit(False))
    ordered = heads | (F.size(F.split("text", "\f")) >= RUNNING_PAGES)
    first = lambda rx, words: F.when(holds(words), F.regexp_extract(F.get(F.filter("said", lambda s: s.rlike(rx)), F.lit(0)), rx, 1))
    plain = docs.where(~ordered).withColumn("said", F.filter(said, lambda s: ~s.rlike(PAGE_NUMBER))).select(
        "key", F.lit(0).cast("long").alias("section"), F.lit(None).cast("string").alias("instrument"), F.lit(None).cast("string").alias("number"),
        F.upper(first(CASE, "case|record|file")).alias("case_number"), first(ADOPTED, "adopted").alias("adopted"),
        F.when(holds("draft"), F.exists("said", lambda s: s.rlike(DRAFT))).otherwise(F.lit(False)).alias("draft"), F.size("said").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_conditions"),
    )
    return _ranked(plain.unionByName(_told(lines_of(docs.where(ordered), "key", "text"))))


def _told(lines: DataFrame) -> DataFrame:
    """What the lines of each section say of its record, and a row more with the number of its conditions."""
    clean = sections(without_running(lines))
    said = F.col("said")
    case = F.nullif(F.regexp_extract(said, CASE, 1), F.lit(""))
    date = F.nullif(F.regexp_extract(said, ADOPTED, 1), F.lit(""))
    at = F.struct("page", "line")
    met = clean.groupBy("key", F.col("section").cast("long").alias("section")).agg(
        F.first("instrument").alias("instrument"), F.first("number").alias("number"), F.min_by(F.upper(case), F.when(case.isNotNull(), at)).alias("case_number"),
        F.min_by(date, F.when(date.isNotNull(), at)).alias("adopted"), F.max(said.rlike(DRAFT)).alias("draft"), F.count("*").alias("n_lines"), F.lit(0).cast("long").alias("n_conditions"),
    )
    read = conditions(lines).where("not implicit").groupBy("key", F.col("section").cast("long").alias("section")).agg(F.lit(0).cast("long").alias("n_lines"), F.count("*").alias("n_conditions"))
    return met.unionByName(read, allowMissingColumns=True)


def _ranked(told: DataFrame) -> DataFrame:
    """Records of what is told of their sections, with the canonical one of each record_key."""
    each = {"instrument": F.max("instrument"), "number": F.max("number"), "case_number": F.min("case_number"), "adopted": F.min("adopted"), "__draft": F.max("draft"), "n_lines": F.sum("n_lines"), "n_conditions": F.sum("n_conditions")}
    met = told.groupBy("key", "section").agg(*[v.alias(c) for c, v in each.items()]).where("n_lines > 0")
    numbered = F.col("number").rlike(r"^\d+$")
    named = met.withColumn("draft", F.col("__draft") | F.coalesce(~numbered, F.lit(False)))
    named = named.withColumn("key_source", F.when(numbered, "number").when(F.col("case_number").isNotNull(), "case").otherwise("document"))
    record = F.when(numbered, F.concat_ws(" ", "instrument", "number")).when(F.col("case_number").isNotNull(), F.concat(F.lit("case "), F.col("case_number"))).otherwise(F.concat_ws("/", F.lit("document"), F.col("key").cast("string"), F.col("section").cast("string")))
    named = named.withColumn("record_key", record)
    place = F.row_number().over(W.partitionBy("record_key").orderBy(F.col("adopted").isNull(), "draft", F.desc("n_conditions"), "key", "section"))
    return named.withColumn("canonical", place == 1).select("key", "section", "record_key", "key_source", "instrument", "number", "case_number", "adopted", "draft", "n_lines", "n_conditions", "canonical")
