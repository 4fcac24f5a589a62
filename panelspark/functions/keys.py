"""Normalisers of dates, parcel keys, case numbers, names and identifiers, as Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def iso_date(x: Column) -> Column:
    """ISO text of an ISO date, `Month d, yyyy` or m/d/y (two-digit years from 90 are 19xx); else blank."""
    x = F.trim(x)
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    year = F.regexp_extract(x, slash, 3)
    full = F.when(F.length(year) == 4, year).when(year >= "90", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    from_slash = F.concat_ws("-", full, F.lpad(F.regexp_extract(x, slash, 1), 2, "0"), F.lpad(F.regexp_extract(x, slash, 2), 2, "0"))
    named = F.regexp_replace(F.regexp_replace(x, r"\.", ""), r"\s+", " ")
    day = F.coalesce(
        F.when(x.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")),
        F.when(x.rlike(slash), F.try_to_date(from_slash, "yyyy-MM-dd")),
        F.when(named.rlike(r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$"), F.coalesce(F.try_to_date(F.regexp_replace(F.initcap(named), ",", ""), "MMMM d yyyy"), F.try_to_date(F.regexp_replace(F.initcap(named), ",", ""), "MMM d yyyy"))),
    )
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\D+", "")


def pad_key(x: Column, width: int) -> Column:
    """Digits padded to the width, letters kept behind: 9a -> 009A. Longer numbers stay as they are; no digits give blank."""
    number = F.regexp_replace(F.regexp_extract(F.upper(F.trim(x)), r"^(\d+)[A-Z]*$", 1), r"^0+(?=\d)", "")
    suffix = F.regexp_extract(F.upper(F.trim(x)), r"^\d+([A-Z]*)$", 1)
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return F.coalesce(F.when(number != "", F.concat(padded, suffix)), F.lit(""))


def parcel_key(block: Column, lot: Column) -> Column:
    """Block of four and lot of three digits, blank if either is."""
    b, l = pad_key(block, 4), pad_key(lot, 3)
    return F.when((b != "") & (l != ""), F.concat(b, l)).otherwise("")


def lot_list(x: Column) -> Column:
    """Lots of a list text, unpadded, letters kept behind their number; O before or between digits reads as 0, what is no lot is left out."""
    parts = F.split(F.regexp_replace(F.upper(x), r"\bAND\b|&", ","), r"[,;/\s]+")
    fixed = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"O(?=\d)|(?<=\d)O", "0"), r"^0+(?=\d)", ""))
    return F.array_distinct(F.filter(fixed, lambda p: p.rlike(r"^\d{1,4}[A-Z]?$")))


def instrument_number(x: Column) -> Column:
    """The first whole number, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def case_number(x: Column) -> Column:
    """Upper-cased without white space, hyphens of all kinds as one."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), r"\s+", ""), r"[‐-―]+", "-")


def case_stem(x: Column) -> Column:
    """Year and serial without the suffix letters: 2015-004568CUA -> 2015-4568; blank if it doesn't read so."""
    rx = r"^(\d{2,4})[-.](\d+)"
    serial = F.regexp_replace(F.regexp_extract(case_number(x), rx, 2), r"^0+(?=\d)", "")
    year = F.regexp_extract(case_number(x), rx, 1)
    return F.when(year != "", F.concat_ws("-", year, serial)).otherwise("")


def expand_year(two: Column, hearing: Column) -> Column:
    """A two-digit year in the largest century that is not after the hearing's year."""
    base = F.floor(hearing / 100) * 100 + two
    return F.when(base <= hearing, base).otherwise(base - 100).cast("int")


def clean_name(x: Column) -> Column:
    """Without honorifics and what is in parentheses, but for a marker (M) or (F), which comes first; initials end with a point, white space is folded."""
    marker = F.upper(F.regexp_extract(x, r"(?i)\(\s*([MF])\s*\)", 1))
    name = F.regexp_replace(x, r"\([^)]*\)", " ")
    name = F.regexp_replace(name, r"(?i)\b(?:mr|mrs|ms|dr|hon|commissioner|president|vice)\b\.?", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"^[\s.,;]+|[\s.,;]+$", ""), r"\s+", " "))
    name = F.regexp_replace(name, r"\b([A-Z])\b\.?\s+", "$1. ")
    return F.when(marker != "", F.concat(F.lit("("), marker, F.lit(") "), name)).otherwise(name)


def surname(x: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(clean_name(x), r"(?i),?\s+(?:jr|sr|ii|iii)\.?$", ""), " "), -1))


#: Where an address is glossed by its place: a side of the street, neighbours, a corner, an alias.
GLOSS = r"(?is)\s*,?\s*(?:(?:north|south|east|west)(?:erly)?\s+side\b|between\b|at\s+the\s+(?:corner|intersection)\b|on\s+the\s+(?:north|south|east|west)\b|near\s+the\b|adjacent\s+to\b|\(a\.?k\.?a\b).*$"


def address_core(x: Column) -> Column:
    """The address up to where its place is glossed, without what ends it; street names like North Point stay whole."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), GLOSS, ""), r"[\s,;]+$", "")


def address_key(x: Column) -> Column:
    """The core in lower-cased letters and digits, street words shortened: what two spellings share."""
    short = reduce(lambda a, r: F.regexp_replace(a, rf"(?i)\b{r[0]}\b\.?", r[1]), (("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("road", "rd"), ("drive", "dr"), ("court", "ct")), address_core(x))
    return F.trim(F.regexp_replace(F.lower(short), r"[^a-z0-9]+", " "))


def ladder(x: Column, table: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that the lower-cased text holds."""
    return reduce(lambda acc, r: F.when(F.lower(x).rlike(r[0]), F.lit(r[1])).otherwise(acc), reversed(table), F.lit(other))


def enum(x: Column, vocabulary: list[str]) -> Column:
    """Lower case with underscores; what is not in the vocabulary is blank, or kept if the vocabulary has `other`."""
    value = F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_")
    return F.when(value.isin(vocabulary), value).otherwise(value if "other" in vocabulary else F.lit(""))
