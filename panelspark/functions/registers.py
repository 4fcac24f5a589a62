"""Registers of fees as printed: rows that begin where a code is named, labels carried to the rates below, bands of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes that begin a row of the register, categories a rate may belong to, and the units of bands and rates.
CODES = ("Planning Code", r"State Ed\.? Code", "Public Works Code", "Administrative Code", "Subdivision Code", "Building Code", "Health Code", "Police Code", "SFPUC Resolution", "Municipal Code")
CATEGORIES = (
    "residential", "non-?residential", "hospitals?", "medical services", "pdr", "office", "retail", "hotel", "entertainment", "institutional", "industrial",
    "senior housing", "laboratory", "small enterprise workspace", "research (?:&|and) development",
)
BAND_UNITS = (r"units?", "gsf", r"g\.s\.f\.", r"sq\.?\s*ft", r"square\s+feet", r"s\.f\.")
RATE_UNITS = (
    r"gross square (?:foot|feet)", r"gross sq\.? ?ft\.?", "gsf", r"net square (?:foot|feet)", "nsf", r"square (?:foot|feet)", r"sq\.? ?ft\.?", r"s\.f\.", "unit",
    "required tree", "gross floor area",
)
EDUCATION = "EdCode"
#: A control character that marks a cut; one in the text reads as a space.
CUT = "\u0001"

_NUMBER = r"[\d,]*\d[\d,]*"
_any = "|".join


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def fee_band(label: Column) -> Column:
    """struct<low, high, unit> of a label's first band of size: "21-99 Units" has both ends, ">99,999 gsf" and "<10 units" one; a label without a band has none."""
    units = f"({_any(BAND_UNITS)})"
    both = rf"(?i)(?:[<>≥≤]\s*)?({_NUMBER})(?:\s*[-–—]|\s+to\s)\s*({_NUMBER})\s*{units}"
    one = rf"(?i)([<>≥≤])\s*({_NUMBER})\s*{units}"
    text = F.coalesce(label, F.lit(""))
    # 0 where there is none: the earlier of the two forms is the band.
    at = lambda rx: F.when(text.rlike(rx), F.instr(text, F.regexp_extract(text, rx, 0))).otherwise(0)
    ranged = (at(both) > 0) & ((at(one) == 0) | (at(both) <= at(one)))
    upward = F.regexp_extract(text, one, 1).isin(">", "≥")
    end = _amount(F.regexp_extract(text, one, 2))
    single = at(one) > 0
    low = F.when(ranged, _amount(F.regexp_extract(text, both, 1))).when(single & upward, end)
    high = F.when(ranged, _amount(F.regexp_extract(text, both, 2))).when(single & ~upward, end)
    unit = F.when(ranged, F.lower(F.regexp_extract(text, both, 3))).when(single, F.lower(F.regexp_extract(text, one, 3)))
    return F.struct(low.alias("low"), high.alias("high"), unit.alias("unit"))


def rate_label(lead: Column) -> Column:
    """The category or band that ends the text before a rate, "" where none does: a guessed label is worse than none. What stands before a last "PLUS" belongs to another rate."""
    size = rf"[<>]?[\d,]+[-–][\d,]+ ?(?:units?|gsf|g\.s\.f\.)|[<>][\d,]+ ?(?:units?|gsf|g\.s\.f\.)"
    own = F.trim(F.element_at(F.split(F.regexp_replace(F.trim(lead), r":+$", ""), "PLUS"), -1))
    return F.trim(F.regexp_extract(F.coalesce(own, F.lit("")), rf"(?i)({_any(CATEGORIES)}|{size})\s*:?\s*$", 1))


def register_rates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, line, section, label, rate, unit): every rate of every row of a register's pages, in order of lines from 0 within a row.

    A row begins at each line that names a code and ends before the next; lines before the first are the page's head. Its
    section is the first one named anywhere in it, or EdCode. A rate's label stands before it on its line, else it is the last
    one that ended a line of the row so far. One pass without a shuffle; labels are folded over the lines of one row at a time.
    """
    code = rf"(?i)\b(?:{_any(CODES)})\b"
    rate = rf"(?i)\$([\d,]+(?:\.\d+)?)\s*(?:per|/|X)?\s*({_any(RATE_UNITS)})?"
    rows = df.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), rf"\n(?=[^\n]*{code})")).alias("block", "body")).where(F.col("body").rlike(code))
    section = F.when(F.col("body").rlike(r"(?i)State Ed\.? Code"), F.lit(EDUCATION)).otherwise(F.regexp_extract("body", r"(?i)\bSection\s+(\d{2,3}[A-Za-z]?(?:\.\d+)?)\b(?!\d)", 1))
    start = F.struct(F.lit("").alias("label"), F.array().cast("array<struct<said:string,label:string>>").alias("lines"))

    def fold(state: Column, said: Column) -> Column:
        label = F.coalesce(F.nullif(rate_label(said), F.lit("")), state["label"])
        return F.struct(label.alias("label"), F.array_append(state["lines"], F.struct(said.alias("said"), label.alias("label"))).alias("lines"))

    lines = rows.select(key, "block", section.alias("section"), F.posexplode(F.aggregate(F.split("body", "\n"), start, fold, lambda s: s["lines"])).alias("line", "l"))
    # A line is cut behind each of its rates: every part but the last ends in one.
    parts = F.split(F.regexp_replace(F.replace("l.said", F.lit(CUT), F.lit(" ")), rate, "$0" + CUT), CUT)
    cut = lines.where(F.col("l.said").contains("$")).select(key, "block", "line", "section", F.col("l.label").alias("carried"), parts.alias("parts"))
    each = cut.select(key, "block", "line", "section", "carried", "parts", F.posexplode("parts").alias("nth", "part")).where(F.col("part").rlike(rf"{rate}$"))
    lead = F.concat(F.array_join(F.slice("parts", 1, F.col("nth")), ""), F.regexp_replace("part", rf"{rate}$", ""))
    label = F.coalesce(F.nullif(rate_label(lead), F.lit("")), F.col("carried"))
    value = _amount(F.regexp_extract("part", rf"{rate}$", 1))
    return each.select(key, "block", "line", "nth", "section", label.alias("label"), value.alias("rate"), F.lower(F.regexp_extract("part", rf"{rate}$", 2)).alias("unit")).where("rate is not null")
