"""Fields of an agenda item's block, as Column -> Column: what is asked, where, by whom, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import keys as K
from panelspark.functions.textops import bound

#: The request that a case number's suffix stands for, three letters before one; of one-letter ones the first counts.
SUFFIXES = {"CUA": "conditional_use", "PCA": "planning_code_amendment", "GPA": "general_plan_amendment", "DRP": "discretionary_review", "DRM": "discretionary_review", "ENV": "ceqa_environmental", "MAP": "rezoning_map_amendment", "OFA": "office_allocation", "LPA": "large_project_authorization"}
LETTERS = {"C": "conditional_use", "D": "discretionary_review", "V": "variance", "Z": "rezoning_map_amendment", "T": "planning_code_amendment", "E": "ceqa_environmental", "X": "large_project_authorization", "H": "historic", "L": "historic", "R": "downtown_project"}
#: Families of decisions by their words, in order: an intent and a refusal before an approval, a continuance before what it continues.
_DR = r"(?:discretionary|\bd\.?r\b)"
DECISIONS = (
    (r"intent.*(?:disapprov|den(?:y|ied))|(?:disapprov|den(?:y|ied)).*intent", "intent_to_disapprove"), (r"intent.*approv|approv.*intent", "intent_to_approve"),
    (rf"(?=.*{_DR}).*(?:did not|not to|declin\w*|\bno)\b.{{0,7}}\btake|\bno d\.?r\b", "did_not_take_dr"), (rf"(?=.*{_DR})(?=.*approv).*took", "took_dr_and_approved"), (rf"(?=.*{_DR}).*(?:took|take)", "took_dr"),
    ("indefinit", "continued_indefinitely"), ("continu", "continued"), ("withdrawn", "withdrawn"), ("fail", "motion_failed"), ("disapprov|denied", "disapproved"), ("approv", "approved"),
    ("adopt", "adopted"), ("certif", "certified"), ("uph[eo]ld", "upheld"), ("initiat", "initiated"), ("filed", "filed"), (r"no action|informational|^\s*none\b", "no_action"),
)
ADVICE = (
    ("pending", "pending"), (r"certif.*(?:\beir\b|environmental impact report)", "certify_eir"), (r"uphold.*(?:neg(?:ative)? dec|mitigated)", "uphold_neg_dec"),
    (r"(?:do(?:es)?|did)? ?not (?:to )?.{0,6}take.*discretionary", "did_not_take_dr"), (r"(?=.*approv)(?=.*take).*discretionary", "took_dr_and_approved"), (r"take.*discretionary|discretionary.*take", "took_dr"),
    (r"disapprov|den(?:y|ied)", "disapprove"), ("approv", "approve"), ("initiat", "initiate"), ("adopt", "adopt"), ("no action|informational", "no_action"),
)
_IN = r"[^\S\n]*"
_LABELS = "RESOLUTION|MOTION|EXCUSED|ABSENT|RECUSED|NOES|NAYES|NAYS|AYES|ACTION|SPEAKERS?|PRELIMINARY RECOMMENDATION|DRA"
#: Where a label's value ends: a label at the start of a line, or one before a colon.
_END = rf"(?i)\n{_IN}(?:{_LABELS})\b|\b(?:{_LABELS}){_IN}(?:\(s\))?{_IN}:"
_CASE = r"\b((?:\d\d|(?:19|20)\d\d)[.-] ?\d{3,}(?!\d|[.-]\d)[A-Za-z0-9/]*(?: [A-Z](?![A-Za-z]))*)"
_DATE = r"(?i)continu\w+\s+to\s+([a-z]+ \d{1,2},? \d{4}|\d{1,2}/\d{1,2}/(?:\d{4}|\d\d))"


def _found(text: Column, rx: str, group: int = 1) -> Column:
    """A pattern's first group, white space folded; blank where it doesn't match."""
    return F.trim(F.regexp_replace(F.coalesce(F.regexp_extract(text, rx, group), F.lit("")), r"\s+", " "))


def _of(table: tuple, text: Column, other: str = "other") -> Column:
    """The label of the first pattern that a text holds; blank for a blank text."""

    def label_of(text: Column) -> Column:
        out = F.lit(other)
        for rx, label in reversed(table):
            out = F.when(text.rlike("(?is)" + rx), label).otherwise(out)
        return F.when(F.trim(text) == "", "").otherwise(out)

    return bound(text, label_of)


def after(text: Column, label: str) -> Column:
    """What stands behind a label that begins a line, up to the next label; blank where it does not stand there."""
    rest = F.coalesce(F.get(F.split(F.concat(F.lit("\n"), text), rf"(?i)\n{_IN}(?:{label}){_IN}(?:\(s\))?{_IN}:", 2), 1), F.lit(""))
    return F.regexp_replace(F.get(F.split(rest, _END, 2), 0), r"^\s+|\s+$", "")


def request_of(case: Column) -> Column:
    """The request that a case number's suffix names; blank where it names none."""
    return bound(F.upper(F.regexp_extract(case, r"^[\d.-]+?\d{3,}([A-Za-z/]+)", 1)), _request)


def _request(suffix: Column) -> Column:
    table = lambda d: F.create_map(*[F.lit(v) for p in d.items() for v in p])
    one = F.get(F.filter(F.transform(F.split(suffix, ""), lambda c: F.try_element_at(table(LETTERS), c)), lambda v: v.isNotNull()), 0)
    out = F.coalesce(one, F.lit(""))
    for code, kind in reversed(SUFFIXES.items()):
        out = F.when(suffix.contains(code), kind).otherwise(out)
    return out


def names(x: Column) -> Column:
    """array<string>: names of a vote, at commas, semicolons and `and`; `none` is none."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)\b(?:and|none)\b", ","), r"[,;\n]"), lambda p: F.regexp_replace(p, r"^[\s.]+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def speakers(block: Column) -> Column:
    """array<struct<name, stance, stance_basis>>: who spoke, a line each, with the stance that a mark before the names gives: + for, - against, = and both neither."""
    said = F.coalesce(F.get(F.split(F.concat(F.lit("\n"), block), rf"(?i)\n{_IN}SPEAKERS?{_IN}(?:\(s\))?{_IN}:", 2), 1), F.lit(""))
    section = F.get(F.split(said, rf"(?i)\n{_IN}(?:ACTION|AYES)\b", 2), 0)
    mark = r"^[(\[]?\s*([+=-])\s*/?\s*([+-])?\s*[)\]]?\s+"

    def line(raw: Column) -> Column:
        sign = F.concat(F.regexp_extract(raw, mark, 1), F.regexp_extract(raw, mark, 2))
        stance = bound(sign, lambda sign: F.when(sign == "+", "support").when(sign == "-", "oppose").when(sign.isin("=", "+-", "-+"), "neutral").otherwise(""))
        who = F.get(F.split(F.regexp_replace(raw, mark, ""), r"\s[–-]\s", 2), 0)
        return bound(stance, lambda stance: F.transform(names(who), lambda n: F.struct(n.alias("name"), stance.alias("stance"), F.when(stance != "", "marker").otherwise("").alias("stance_basis"))))

    return F.flatten(F.transform(F.transform(F.split(section, r"\n"), lambda l: F.trim(l)), line))


def fields(block: Column) -> Column:
    """struct of what an item's block says; blank, empty or null (numbers) where it doesn't.

    The decision is read from the line that begins with ACTION alone, the date it is continued to from there before the rest
    of the block (an agenda's proposal stands above), conditions from ACTION on: what stands above may be an earlier
    entitlement's. Stances come from marks, and counts from stances.
    """
    return bound(F.coalesce(block, F.lit("")), lambda t: bound(_parts(t), lambda p: _fields(t, p)))


def _parts(t: Column) -> Column:
    """struct of the block's parts that several fields are read from."""
    case = F.regexp_replace(_found(t, _CASE), r"\s+", "")
    tail = F.coalesce(F.get(F.split(F.concat(F.lit("\n"), t), rf"(?i)\n{_IN}ACTION{_IN}:", 2), 1), F.lit(""))
    return F.struct(case.alias("case"), after(t, "ACTION").alias("action"), tail.alias("tail"), after(t, "Preliminary Recommendation").alias("advice"), speakers(t).alias("spoke"))


def _until(t: Column, tail: Column) -> Column:
    """The date that a block is continued to."""
    said = lambda x: bound(_found(x, _DATE), lambda d: F.nullif(d, F.lit("")))
    forever = t.rlike("(?i)indefinite") & t.rlike("(?i)continu")
    iso = lambda day: bound(K.iso_date(day), lambda d: F.nullif(d, F.lit("")))
    return bound(F.coalesce(said(tail), said(t)), lambda day: F.when(day.isNotNull(), F.coalesce(iso(day), day)).when(forever, "indefinite").otherwise(""))


def _fields(t: Column, p: Column) -> Column:
    case, action, tail, advice, spoke = (p[c] for c in ("case", "action", "tail", "advice", "spoke"))
    low = F.lower(action)
    imposed = low.rlike(r"with (?:the )?(?:following |modified )?condition") | ((action != "") & ~low.rlike("continu|withdraw") & F.lower(tail).rlike(r"subject to the (?:following |attached )?conditions?|conditions? of approval"))
    stance = lambda s: F.size(F.filter(spoke, lambda x: x["stance"] == s))
    street = r"(?i)(?:^|\n)\s*([0-9][0-9A-Z/ -]{1,40}(?:STREET|AVENUE|BOULEVARD|ROAD|DRIVE|PLACE|WAY|TERRACE|LANE|COURT|CIRCLE))\b"
    instrument = r"(?i)\b(Motion|Resolution|DRA)\s*(?:No\.?|#)?\s*[:#]?\s*(\d+)"
    return F.struct(
        case.alias("case_number"), request_of(case).alias("request_type"), _found(t, r"(?i)Assessor.{0,3}s?\s+Block\s+([0-9A-Z]+)").alias("assessor_block"),
        F.regexp_replace(_found(t, r"(?i)\bLots?\s+([0-9A-Z,\s]+?)\s+in\s+Assessor"), ",$", "").alias("lot_number"),
        _found(t, r"\b([A-Z]{1,4}-?\d[A-Z]?)\s*\([^)]+\)\s*District").alias("type_district"), F.lower(_found(t, r"\b[A-Z]{1,4}-?\d[A-Z]?\s*\(([^)]+)\)\s*District")).alias("type_district_descr"),
        _found(t, r"\b(\d{2,3}-[A-Z])\b").alias("height_and_bulk_district"), F.initcap(_found(t, street)).alias("project_address"),
        _found(t, r"(?is)(Request for .+?)(?:\(Continued|\(Proposed|Preliminary\s+Recommendation|SPEAKERS?\b|\n\n|$)").alias("project_descr"),
        F.initcap(_found(t, r"\(\s*([A-Z]\.?\s*[A-Za-z][A-Za-z'-]+)\s*:?\s*\(?\d{3}\)?[\s-]?\d{3}")).alias("staff_planner"),
        advice.alias("preliminary_recommendation"), _of(ADVICE, advice).alias("preliminary_recommendation_category"), _until(t, tail).alias("continued_to"), _of(DECISIONS, action).alias("action"),
        F.when(imposed, "yes").otherwise("").alias("conditions_imposed"), F.when(low.rlike("as modified|as amended|revised plan|modified condition"), "yes").otherwise("").alias("project_modified"),
        spoke.alias("speakers"), stance("support").alias("support_count"), stance("oppose").alias("oppose_count"), stance("neutral").alias("neutral_count"),
        *[names(after(t, label)).alias(label.lower()) for label in ("AYES", "NOES", "ABSENT", "RECUSED", "EXCUSED")],
        F.lower(_found(t, instrument)).alias("action_instrument"), F.nullif(_found(t, instrument, 2), F.lit("")).try_cast("int").alias("action_instrument_no"),
    )
