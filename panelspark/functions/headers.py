"""The ten fields of a meeting read from the text about its header, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.textops import bound

#: What a name may stand beside without being part of it, degrees, and who else sits together with a commission.
TITLES = r"(?:acting\s+)?(?:vice[\s-]?president|vp|president|chair(?:person|man|woman)?|commissioners?|comm\.?|secretary)"
ROLES = r"(?i)^(?:acting\s+)?(?:deputy\s+)?(?:director(?:\s+of\s+[a-z ]+)?|zoning administrator|city attorney|planning director|(?:commission |transcription )?secretary|chief[a-z ]*)$"
DEGREES = r"^(?:(?:[A-Za-z]\.){1,4}[A-Za-z]?\.?|(?i:ph\.?d|ed\.?d|m\.?d|j\.?d|r\.?n|esq|aicp)\.?)$"
BODIES = ("REDEVELOPMENT AGENCY", "HISTORIC PRESERVATION", "RECREATION AND PARK", "BOARD OF SUPERVISORS", "TRANSPORTATION AUTHORITY", "BUILDING INSPECTION", "PUBLIC HEALTH")
_BODY = "(?:" + "|".join(BODIES) + ")"
_PRESENT = r"(?i:(?:[a-z]+[^\S\n]+)?commissioners?\s+present\s*:?|(?<![A-Za-z])present\s*:)"
_ABSENT = r"(?i:(?:[a-z]+[^\S\n]+)?commissioners?\s+absent\s*:?|(?<![A-Za-z])absent\s*:)"
_STAFF = r"(?i:staff\s+in\s+attendance\s*:?|(?<![A-Za-z])in\s+attendance\s*:|(?<![A-Za-z])staff\s*:)"
#: A line that no list of people goes on over: another label, the gavel, a divider, a section's letter, another body.
_STOP = r"^\s*(?:(?i:(?:[a-z]+\s+)?commissioners?\s+(?:present|absent|excused|recused)|(?:present|absent|excused|recused)\s*:|staff\b|(?:the\s+)?meeting\s+was|called\s+to|the\s*$|speakers?\b|adjourn|consideration\s+of)|[A-Z]\.(?:\s*$|\s+[A-Z]{2})|\d+\.\s|" + _BODY + r"|[A-Z][A-Z /&-]{3,}:)"
_NAME = r"(?!(?i:at|am|pm|the|and|vice|president|meeting|regular|special|joint|closed|session|minutes|calendar|commission(?:ers)?|hearing|present|absent|staff|room|chambers|attendance)\b)[A-Z][\w.'-]*"
_FULL = _NAME + r"(?:\s+" + _NAME + r"){0,2}"


def _folded(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")


def _cased(name: Column) -> Column:
    """Words in capitals as names: WILLIAMS -> Williams, MCGARRY -> McGarry."""
    word = lambda w: F.when(w.rlike(r"^(?:MC|MAC)[A-Z]{3,}$"), F.concat(F.initcap(F.regexp_extract(w, "^(MC|MAC)", 1)), F.initcap(F.regexp_extract(w, "^(?:MC|MAC)(.*)$", 1)))).when(w.rlike(r"^[A-Z]{2,}$"), F.initcap(w)).otherwise(w)
    return F.array_join(F.transform(F.split(name, r"\s+"), word), " ")


def after(text: Column, label: str, lines: int = 4) -> Column:
    """What follows a label's first place, with up to so many lines more until one is blank or begins something else; blank where the label isn't there."""
    said = F.split(F.get(F.split(text, label, 2), 1), r"\n")

    def listed(said: Column) -> Column:
        more = F.slice(said, 2, lines)
        ends = F.filter(F.transform(more, lambda l, i: F.when((F.trim(l) == "") | l.rlike(_STOP), i)), lambda i: i.isNotNull())
        kept = F.slice(more, 1, F.coalesce(F.array_min(ends), F.size(more)))
        # A label that ends its line is followed by the list.
        return F.coalesce(_folded(F.array_join(F.concat(F.slice(said, 1, 1), kept), " ")), F.lit(""))

    return bound(said, listed)


def people(x: Column, roles: bool = False) -> Column:
    """array<string>: the names of a list of people, without titles, degrees, labels and what has no letter.

    With roles a job after a comma belongs to the name before it: "Ann Roe, Director of Planning" is one entry.
    """
    parts = F.transform(F.split(_folded(F.coalesce(x, F.lit(""))), r"[,;]| and (?=[A-Z])"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    if roles:
        glue = lambda acc, p: F.when(p.rlike(ROLES) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" - ", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p)))
        parts = F.aggregate(parts, F.array().cast("array<string>"), glue)
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, rf"(?i)\s*[-–]\s*{TITLES}\s*$", ""), rf"(?i)^(?:{TITLES})(?:\s+|$)", ""))
    # A label in capitals inside a name: the list ran on into the next.
    bare = F.transform(bare, lambda p: F.regexp_replace(F.get(F.split(p, r"\b(?:PRESENT|ABSENT|EXCUSED|RECUSED|STAFF)\b", 2), 0), r"^[ .,;:\"']+|[ .,;:\"']+$", ""))
    dashed = F.transform(bare, lambda p: F.regexp_replace(p, r"\s+[-–=]+\s*(?:[-–]\s*)?|\s*[-–]\s+", " - "))
    named = F.filter(dashed, lambda p: p.rlike(r"\p{L}") & ~p.rlike(DEGREES) & ~F.lower(p).isin("none", "n/a", "present", "absent"))
    return F.transform(named, _cased)


def place(window: Column, date_line: Column) -> Column:
    """The building within six lines of the date, without its room: a remote hearing, a known venue, else a named hall and its street."""
    lines = F.split(window, r"\n")
    at = lambda lines: F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda l: F.trim(l)), F.trim(date_line)), F.lit(0)), F.floor(F.size(lines) / 2) + 1).cast("int")
    near = lambda lines, at: F.array_join(F.slice(lines, F.greatest(at - 6, F.lit(1)), at + 6 - F.greatest(at - 6, F.lit(1)) + 1), "\n")
    band = bound(lines, lambda lines: bound(at(lines), lambda at: near(lines, at)))
    return bound(band, lambda band: bound(F.regexp_replace(band, r"\s+", " "), lambda flat: _building(band, flat)))


def _building(band: Column, flat: Column) -> Column:
    street = _folded(F.regexp_extract(flat, r"(\b\d+ (?:[A-Z0-9][\w.'-]* ){1,4}?(?i:avenue|ave|street|st|boulevard|blvd|place|plaza|way|road)\b)", 1))
    hall = _folded(F.regexp_replace(F.regexp_extract(band, r"(?im)^([^\n\d]*\b(?:school|auditorium|cent(?:er|re)|library|theat(?:er|re)|hall)\b[^\n\d]*)$", 1), r"(?i)\s*[-–]\s*(?:auditorium|gymnasium|cafeteria|multipurpose room).*$", ""))
    found = F.concat_ws(", ", F.nullif(hall, F.lit("")), F.nullif(street, F.lit("")))
    return F.when(flat.rlike(r"(?i)remote hearing|teleconference"), "Remote hearing").when(flat.rlike(r"(?i)war memorial"), "War Memorial Building").when(flat.rlike(r"(?i)city hall"), "City Hall").otherwise(found)


def _named(text: Column, rx: str) -> Column:
    return bound(_folded(F.regexp_extract(text, rx, 1)), lambda name: F.nullif(name, F.lit("")))


def presiding(text: Column) -> Column:
    """The name before ", President", else who called to order as president or chair, else the name after President; null where none stands there."""
    return bound(F.regexp_replace(text, r"\s+", " "), _president)


def _president(flat: Column) -> Column:
    chair = r"(?i:called to order by (?:acting )?(?:vice[ -]?)?(?:president|chair(?:person)?) )(" + _FULL + ")"
    return _cased(F.coalesce(_named(flat, "(" + _FULL + r")\s*[,–-]\s*President\b"), _named(flat, chair), _named(flat, r"(?<!(?i:vice)[ -])\b(?i:president) (" + _FULL + ")")))


def fields(window: Column, date_line: Column, extended: Column | None = None) -> Column:
    """struct of meeting_type, meeting_time, presiding, location, present, absent, staff, joint_body, joint_body_present, notes.

    Rolls, time and staff are read below the date, since what stands above it may be the last meeting's end; type and who
    presides from the whole window, since the masthead stands above it. Rolls that are not in the window are sought in
    `extended`, the meeting's text up to its first item. Of a joint meeting the president is the one of the first roll: by
    the title there, else who called to order if that roll has the name, else blank. What isn't found is blank or empty, and
    so are all fields of a null window.
    """
    wide = F.coalesce(extended, F.lit("")) if extended is not None else F.lit("")
    texts = F.struct(F.coalesce(window, F.lit("")).alias("w"), F.coalesce(date_line, F.lit("")).alias("d"), wide.alias("wide"))

    def below(v: Column) -> Column:
        at = F.when(v["d"] != "", F.position(v["d"], v["w"])).otherwise(0)
        return bound(at, lambda at: F.when(at > 0, F.substring(v["w"], at + F.length(v["d"]), F.length(v["w"]))).otherwise(v["w"]))

    return bound(texts, lambda v: bound(below(v), lambda body: bound(_found(v["w"], body, v["wide"]), lambda f: _fields(v["w"], v["d"], body, v["wide"], f))))


def _found(w: Column, body: Column, wide: Column) -> Column:
    """struct of what several fields go by: two bodies, the word beside `meeting`, who presides, whether it is joint, the roll of those present."""
    two = F.regexp_extract(w, r"(?i:planning commission)\s*\n\s*(?i:and|&)\s*\n\s*([A-Z][A-Z ]{6,}COMMISSION)", 1)
    said = F.lower(F.regexp_extract(w, r"(?i)\b(regular|special|joint|closed)\s+(?:[a-z-]+\s+){0,2}(?:meeting|session|hearing)", 1))
    joint = lambda two, said: body.rlike(r"(?i)\bjoint\b") | (said == "joint") | (two != "") | (F.regexp_count(body, F.lit(_PRESENT)) > 1)
    return bound(F.struct(two.alias("two"), said.alias("said")), lambda f: F.struct(f["two"].alias("two"), f["said"].alias("said"), joint(f["two"], f["said"]).alias("joint"), presiding(w).alias("presiding"), _roll(body, wide, _PRESENT).alias("present")))


def _roll(body: Column, wide: Column, label: str) -> Column:
    return bound(people(after(body, label)), lambda names: F.when(F.size(names) > 0, names).otherwise(people(after(wide, label))))


def _fields(w: Column, d: Column, body: Column, wide: Column, f: Column) -> Column:
    two, said, joint, present = f["two"], f["said"], f["joint"], f["present"]
    blank = lambda x: F.coalesce(x, F.lit(""))
    kind = F.when(joint, "joint").when(said == "closed", "closed_session").otherwise(said)
    clock = r"\b(\d{1,2}:\d{2})\s*([APap])\.?\s?[Mm]\b"
    time = F.when(body.rlike(clock), F.concat(F.regexp_extract(body, clock, 1), F.lit(" "), F.upper(F.regexp_extract(body, clock, 2)), F.lit("M"))).otherwise("")
    rolled = lambda t: F.regexp_replace(F.get(F.split(after(t, _STAFF, 12), r"(?i)\b(?:consideration\b|speaker key|items? (?:to be|proposed for) continu)", 2), 0), r"(?is)((?:acting\s+)?commission\s+secretary).*$", "$1")
    staff = bound(rolled(body), lambda t: F.when(t != "", t).otherwise(rolled(wide)))
    others = F.split(body, r"\n\s*" + _BODY + r"[A-Z ]*:?\s*\n|" + _PRESENT, -1)
    own = F.regexp_replace(blank(F.get(others, 1)), r"\s+", " ")
    titled = bound(own, lambda own: F.coalesce(_named(own, "(" + _FULL + r")\s*[,–-]\s*President\b"), _named(own, r"(?<!(?i:vice)[ -])\b(?i:president) (" + _FULL + ")")))
    last = lambda n: F.lower(F.element_at(F.split(n, " "), -1))
    sat = F.when(F.array_contains(F.transform(present, last), last(f["presiding"])), f["presiding"])
    named_body = F.coalesce(F.nullif(two, F.lit("")), F.nullif(F.regexp_extract(w, r"(?m)^\s*(" + _BODY + r"[A-Z ]*?)\s*:?\s*$", 1), F.lit("")))
    rolls = F.split(body, _PRESENT, -1)
    second = F.when(joint, bound(rolls, lambda r: F.when(F.size(r) > 2, people(after(F.concat(F.lit("PRESENT:"), F.element_at(r, -1)), _PRESENT)))))
    return F.struct(
        kind.alias("meeting_type"), time.alias("meeting_time"), blank(F.when(joint, F.coalesce(_cased(titled), sat)).otherwise(f["presiding"])).alias("presiding"), place(w, d).alias("location"),
        present.alias("present"), _roll(body, wide, _ABSENT).alias("absent"), people(staff, roles=True).alias("staff"),
        F.when(joint, blank(F.initcap(_folded(named_body)))).otherwise("").alias("joint_body"), F.coalesce(second, F.array().cast("array<string>")).alias("joint_body_present"), F.lit("").alias("notes"),
    )
