"""Text measures: masking, durations, hours, quantities, citations, evidence, similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts in words, words that masks take for numbers, and words of periods.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90, "hundred": 100}
MASKED_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "twelve", "eighteen", "twenty", "thirty", "forty", "sixty")
PERIOD_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "ten": 10, "twelve": 12, "eighteen": 18, "twenty four": 24, "thirty six": 36}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What the body makes of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(x: Column) -> Column:
    """Typographic signs as ASCII, white space folded."""
    return F.trim(F.regexp_replace(F.translate(x, "‘’“”–— ", "''\"\"-- "), r"\s+", " "))


def mask(x: Column) -> Column:
    """Numbers, dates and number words as #, everything but letters and # as one space."""
    numbered = F.regexp_replace(F.lower(x), rf"\d+(?:[,./:-]+\d+)*[,./:-]*|\b(?:{'|'.join(MASKED_WORDS)})\b", "#")
    return F.trim(F.regexp_replace(numbered, r"[^a-z#]+", " "))


def template_key(x: Column, chars: int = 200) -> Column:
    return F.substring(mask(x), 1, chars)


def durations(x: Column) -> Column:
    """array<double>: every stated period in months: three (3) years, 36 months, twenty-four months.

    A grammar over the text's tokens: a unit, before it an optional closing bracket, then a count in digits, which go
    first, or in one or two words, a hyphen between them or not. Counts of 0 and units without a count are no period.
    """
    tokens = F.regexp_extract_all(F.lower(x), F.lit(r"[a-z]+|\d+|[^\sa-z\d]"), F.lit(0))
    counts = F.create_map(*[F.lit(v) for p in PERIOD_WORDS.items() for v in p])

    def count(tokens: Column, i: Column) -> Column:
        at = lambda back: F.coalesce(F.get(tokens, i - back), F.lit(""))
        closed = F.when(at(1) == ")", 1).otherwise(0)
        last, before, first = at(closed + 1), at(closed + 2), at(closed + 3)
        two = F.concat_ws(" ", F.when(before == "-", first).otherwise(before), last)
        digits = F.when(last.rlike(r"^\d{1,3}$"), last.try_cast("double"))
        return F.coalesce(digits, F.try_element_at(counts, two).cast("double"), F.try_element_at(counts, last).cast("double"))

    def periods(tokens: Column) -> Column:
        # Only units ask for what stands before them.
        months = lambda unit, i: F.when(unit.isin("year", "years"), count(tokens, i) * 12).when(unit.isin("month", "months"), count(tokens, i))
        return F.filter(F.transform(tokens, months), lambda n: n > 0)

    return bound(tokens, periods)


_CLOCK = r"(\d{1,2})(?::(\d\d))?\s*([ap])\.?\s?m\.?"
_RANGE = rf"{_CLOCK}\s*(?:to|through|until|-|–|—)\s*{_CLOCK}"
_ALL_DAY = r"24[\s-]*hours?(?:\s+(?:a|per))?\s+day"


def hours(x: Column) -> tuple[Column, Column]:
    """Opening and closing hour of the first time range, in decimal hours, past midnight from 24 on; 0 and 24 for 24 hours a day."""

    def at(said: Column, h: int) -> Column:
        got = lambda g: F.regexp_extract(said, _RANGE, g)
        hour = got(h).try_cast("int") % 12 + F.when(got(h + 2) == "p", 12).otherwise(0)
        return hour + F.coalesce(got(h + 1).try_cast("int"), F.lit(0)) / 60

    # The whole text is searched once; the hours are read from what was found.
    said, whole = F.regexp_extract(F.lower(x), _RANGE, 0), F.lower(x).rlike(_ALL_DAY)
    span = bound(said, lambda s: F.struct(at(s, 1).alias("start"), at(s, 4).alias("end")))
    closing = bound(span, lambda r: F.when(r["end"] <= r["start"], r["end"] + 24).otherwise(r["end"]))
    return F.when(whole, 0.0).otherwise(span["start"]), F.when(whole, 24.0).otherwise(closing)


def hours_days(x: Column, around: int = 40) -> Column:
    """24 hours, daily, weekend, weekday or unspecified: the days named within so many characters of the first time range; null without one."""
    low = F.lower(x)
    place = F.regexp_instr(low, F.lit(_RANGE))
    said = F.substring(low, F.greatest(place - around, F.lit(1)), F.least(place - 1, F.lit(around)) + F.length(F.regexp_extract(low, _RANGE, 0)) + around)
    names = "mon|tues|wednes|thurs|fri|satur|sun"
    days = F.regexp_extract_all(said, F.lit(rf"\b(?:(?:{names})days?|weekdays?|weekends?|daily|every day|seven days|7 days)\b"), F.lit(0))
    kind = F.when(F.exists(days, lambda d: d.isin("daily", "every day", "seven days", "7 days")), "daily").when(F.size(days) == 0, "unspecified").when(F.forall(days, lambda d: d.rlike("^(?:satur|sun|weekend)")), "weekend").otherwise("weekday")
    return F.when(low.rlike(_ALL_DAY), "24 hours").when(place > 0, kind)


#: Units of stated quantities, each with its spelling beside any count but 1, and beside 1.
UNITS = {"year": ("years", "year"), "month": ("months", "month"), "day": ("days", "day"), "hour": ("hours", "hour"), "unit": ("units", "unit"), "space": ("spaces", "space"), "feet": ("feet", "foot"), "percent": ("percent", "percent"), "a.m.": ("a.m.", "a.m."), "p.m.": ("p.m.", "p.m.")}


def stated_quantities(x: Column) -> Column:
    """array<string>: each stated number with its unit, as "3 years", "1 foot", "10 percent", "9:00 a.m."; a class's number and parts of longer numbers are none."""
    rx = r"(?<![\d.:])(?<!class )(?:\d{1,2}:\d\d|\d[\d,]*(?:\.\d+)?)\s*\)?\s*(?:(?:year|month|day|hour|unit|space)s?|feet|foot|percent|%|[ap]\.?\s?m\b\.?)"
    spelled = F.create_map(*[F.lit(v) for k, (many, _) in UNITS.items() for v in (k, many)])
    alone = F.create_map(*[F.lit(v) for k, (_, one) in UNITS.items() for v in (k, one)])

    def one(m: Column) -> Column:
        n = F.regexp_extract(m, r"^([\d:,.]*\d)", 1)
        unit = F.regexp_extract(m, r"([a-z%][a-z.\s]*)$", 1)
        clock = F.regexp_extract(unit, r"^([ap])\.?\s?m", 1)
        base = F.when(clock != "", F.concat(clock, F.lit(".m."))).when(unit == "%", "percent").when(unit == "foot", "feet").when(unit.isin("feet", "percent"), unit).otherwise(F.regexp_replace(unit, "s$", ""))
        return F.concat_ws(" ", n, F.when(F.replace(n, F.lit(",")) == "1", F.try_element_at(alone, base)).otherwise(F.try_element_at(spelled, base)))

    return F.transform(F.regexp_extract_all(F.lower(x), F.lit(rx), F.lit(0)), one)


def quantities(x: Column) -> Column:
    """array<string>: number and unit of lengths, areas, units, percentages and money, in one spelling."""
    rx = r"\$\s?[\d,]+(?:\.\d+)?|[\d,]+(?:\.\d+)?\s*(?:square feet|sq\.? ?ft|feet|foot|percent|%|dwelling units|units|spaces)"
    found = F.regexp_extract_all(F.lower(x), F.lit(rx), F.lit(0))

    def one(m: Column) -> Column:
        m = F.regexp_replace(F.regexp_replace(m, ",", ""), r"square feet|sq\.? ?ft", "sqft")
        m = F.regexp_replace(F.regexp_replace(m, r"feet|foot", "ft"), r"percent|%", "pct")
        return F.trim(F.regexp_replace(F.regexp_replace(m, "dwelling units", "units"), r"\s+", " "))

    return F.transform(found, one)


def citations(x: Column) -> Column:
    """array<string>: distinct code sections cited, in their order."""
    found = F.regexp_extract_all(x, F.lit(r"[Ss]ections?\s+(\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"), F.lit(1))
    return F.array_distinct(found)


def evidence(quote: Column, source: Column) -> Column:
    """found, blank, missing source or not found: whether the quotation stands in the source, white space aside."""
    q = F.coalesce(fold(quote), F.lit(""))
    return F.when(q == "", "blank").when(source.isNull(), "no_source").when(fold(source).contains(q), "found").otherwise("not_found")


def word_set(x: Column, least: int = 4) -> Column:
    """Distinct lower-cased words of at least so many ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"[a-z]{{{least},}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def salvage_json(x: Column, schema: str) -> Column:
    """The object of a text that holds one, or null: as it is, else its outermost braces."""
    return F.coalesce(F.from_json(x, schema), F.from_json(F.regexp_extract(x, r"(?s)(\{.*\})", 1), schema))
