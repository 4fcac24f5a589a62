"""Cuts a text into agenda items, items that were run together, and decisions.

All cuts are made inside the row that holds the text: candidate lines split it, each is judged by what stands before and
behind it, and those that fail are glued back. Cuts shuffle nothing and are linear in a text's length; `resplit` shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Printed dividers of a calendar, which belong to no item.
SECTIONS = ("PUBLIC COMMENT", "GENERAL PUBLIC COMMENT", "REGULAR CALENDAR", "CONSENT CALENDAR", "COMMISSION MATTERS", "COMMISSIONERS' QUESTIONS", "DIRECTOR'S REPORT", "DEPARTMENT MATTERS")
_IN = r"[^\S\n]*"
_CASE = r"(?:\d{1,3}[a-z]?[.)]" + _IN + r")?(?:\d\d|(?:19|20)\d\d)[.-] ?\d{3,}[A-Za-z/]*(?=[\s:(–-])"
_NUMBERED = r"\d{1,2}[a-z]?[.)]\s{1,12}(?:\(|[A-Z]{2})"
_SECTION = r"(?:[A-Z][.)]" + _IN + r")?(?:" + "|".join(s.replace(" ", _IN.replace("*", "+")) for s in SECTIONS) + r")\b"
_CLOSING = r"(?i:adjourn(?:ment|ed)?\b)"
_MINUTES = r"(?i:the\s+draft\s+minutes\s+[\w\s]{0,40}proposed\s+for\s+adoption)"
#: What begins an item, the more particular first.
KINDS = (("case", _CASE), ("section", _SECTION), ("closing", _CLOSING), ("minutes", _MINUTES), ("numbered", _NUMBERED))
#: A line that says what was decided, and one that gives its number.
ACTION, OWN_NUMBER = r"(?i:ACTION" + _IN + r":)", r"(?im)^" + _IN + r"(?:MOTION|RESOLUTION)" + _IN + r"(?:No\.?)?" + _IN + r":?" + _IN + r"\d{3,}"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _lines_before(text: Column, head: str) -> Column:
    """The text cut before each line that begins so; the first piece is what stands before all of them, or blank."""
    return F.split(F.concat(F.lit("\n"), text), r"\n(?=" + _IN + head + ")", -1)


def _spans(pieces: Column, starts: Column) -> Column:
    """Pieces glued to spans that begin at the given places, counted from 1."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(pieces) + 1))
    return F.zip_with(starts, ends, lambda s, e: F.array_join(F.slice(pieces, s, e - s), "\n"))


def _places(flags: Column) -> Column:
    """The places, from 1, where an array of booleans is true."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())


def kind_of(piece: Column) -> Column:
    """What the first line of a piece is; null where it begins no item."""
    kind = F.lit(None).cast("string")
    for name, rx in reversed(KINDS):
        kind = F.when(piece.rlike(r"^\s*" + rx), F.lit(name)).otherwise(kind)
    return kind


def _begins(pieces: Column) -> Column:
    """Whether each piece begins an item: it reads so, and the text before does not cite it ("as listed in Item / 12.")."""
    cited = lambda before: F.right(F.regexp_replace(before, r"\s+$", ""), F.lit(60)).rlike(r"(?i)\bitems?$")
    before = F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.size(pieces) - 1))
    return F.zip_with(pieces, before, lambda p, b: F.coalesce(kind_of(p) != "numbered", F.lit(False)) | (F.coalesce(kind_of(p) == "numbered", F.lit(False)) & ~cited(b)))


_ANY = "(?:" + "|".join(rx for _, rx in KINDS) + ")"


def items(text: Column) -> Column:
    """array<struct<kind, body>>: the items of a document.

    An item begins at a case number, a number before a title in capitals or a planner in parentheses, a divider, an
    adjournment or a note on draft minutes; numbers that the text before cites do not count. What stands before the first is
    left out. With fewer than two, every numbered line begins an item; without any, the text is one of kind `whole`.
    Null and blank texts have none.
    """
    def cut(clean: Column) -> Column:
        pieces = _lines_before(clean, _ANY)
        marked = _let(pieces, lambda ps: F.transform(_spans(ps, _places(_begins(ps))), lambda s: F.struct(kind_of(s).alias("kind"), _trimmed(s).alias("body"))))
        plain = _let(_lines_before(clean, r"\d+[a-z]?[.)]\s"), lambda ps: F.slice(ps, 2, F.size(ps) - 1))
        numbered = F.transform(plain, lambda s: F.struct(F.lit("numbered").alias("kind"), _trimmed(s).alias("body")))
        whole = F.array(F.struct(F.lit("whole").alias("kind"), _trimmed(clean).alias("body")))
        return _let(marked, lambda m: F.when(F.size(m) >= 2, m).otherwise(_let(numbered, lambda n: F.when(F.size(n) > 0, n).otherwise(whole))))

    # The sign first, then what stands before it: most texts have few.
    noise = r"[!?]{1,4}(?<=\d\d\.\d{3,6}[A-Za-z]{0,8}[!?]{1,4})"
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), noise, "")
    return F.filter(_let(clean, cut), lambda i: i["body"] != "")


def fragments(block: Column) -> Column:
    """array<string>: an item cut where a second one begins inside it.

    A block has one head, so numbered lines alone never cut it. An item with a case number is never cut off from its own
    decision: where the first cut would stand above the line that holds it, the block stays whole.
    """
    text = F.coalesce(block, F.lit(""))

    def cut(pieces: Column) -> Column:
        begins = F.transform(_begins(pieces), lambda b, i: (i == 0) | (b & ~((i == 1) & (_trimmed(pieces[0]) == ""))))
        out = F.filter(F.transform(_spans(pieces, _places(begins)), _trimmed), lambda s: s != "")
        decided = r"(?m)^" + _IN + ACTION
        severed = text.rlike(r"^\s*" + _CASE) & text.rlike(decided) & ~F.coalesce(F.get(out, 0), F.lit("")).rlike(decided)
        return F.when(severed | (F.size(out) == 0), F.array(_trimmed(text))).otherwise(out)

    return _let(_lines_before(text, _ANY), cut)


def decisions(block: Column, head: str = ACTION, own: str = OWN_NUMBER) -> Column:
    """array<string>: a block cut before the second and later decisions that carry a number of their own.

    A decision reaches to the next line that begins like one. Those without a number (a motion that failed) stay with what
    stands before them; with fewer than two numbered ones the block stays whole.
    """

    def cut(pieces: Column) -> Column:
        numbered = _places(F.transform(pieces, lambda p, i: (i > 0) & p.rlike(own)))
        starts = F.concat(F.array(F.lit(1)), F.slice(numbered, 2, F.greatest(F.size(numbered) - 1, F.lit(0))))
        return F.filter(F.transform(_spans(pieces, starts), _trimmed), lambda s: s != "")

    out = _let(_lines_before(F.coalesce(block, F.lit("")), head), cut)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("")))


def resplit(df: DataFrame, doc: str, block_id: str, place: str, text: str, cut: Callable[[Column], Column], carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc, id, parent, place, text, carried...): blocks after a cut; the first fragment keeps the id, the others have none.

    parent is the id of the block that a fragment comes from. Places are counted anew from 0 within a document, in the order
    of the old places (ties by id), so that fragments stand where they stood in the text.
    """
    f = df.select(doc, F.col(block_id).alias("parent"), F.col(place).alias("__place"), *carried, F.posexplode(cut(F.col(text))).alias("__k", text))
    order = W.partitionBy(doc).orderBy("__place", "parent", "__k")
    return f.select(doc, F.when(F.col("__k") == 0, F.col("parent")).alias(block_id), "parent", (F.row_number().over(order) - 1).alias(place), text, *carried)
