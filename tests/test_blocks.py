"""Items, run-together items, decisions and what a new cut does to ids."""

from pyspark.sql import functions as F

from panelspark.operators import blocks as B


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def kinds(spark, text):
    return [(i.kind, i.body) for i in one(spark, B.items, text)]


def test_items_by_head(spark):
    text = "masthead\n1. 2015-006317CUA (J. WU) 12 Elm\nACTION: Approved\n  2. BRIEFING ON POLICY\ntext\nB. PUBLIC COMMENT\nnone\nAdjournment: 7:12 p.m.\nTHE DRAFT MINUTES ARE PROPOSED FOR ADOPTION AT\nthe next"
    assert [k for k, _ in kinds(spark, text)] == ["case", "numbered", "section", "closing", "minutes"]
    assert kinds(spark, text)[0][1].endswith("ACTION: Approved") and kinds(spark, text)[4][1].endswith("the next")


def test_numbers_inside_bodies_do_not_cut(spark):
    text = "1. (A. ROE) one\nSPEAKERS: Same as those listed in Item\n12. (B. WU)\nmore\n2. (C. LEE) two\n270. of the Code, and\n3. first point of a list"
    got = kinds(spark, text)
    assert len(got) == 2 and "12. (B. WU)\nmore" in got[0][1] and got[1][1].endswith("3. first point of a list")
    assert len(kinds(spark, "1. (A. ROE) one\nas listed in items\n\n  12. (B. WU)\n2. (C. LEE) x")) == 2


def test_number_and_title_on_two_lines_and_noise_in_codes(spark):
    assert [k for k, _ in kinds(spark, "1.\n  BRIEFING\nx\n2.\n(A. ROE) y")] == ["numbered", "numbered"]
    assert kinds(spark, "2001.1039E!KBM (A) x\n98.226D: y")[0][1].startswith("2001.1039EKBM (A)")
    assert [k for k, _ in kinds(spark, "2001.1039E (A) x\n98.226D: y")] == ["case", "case"]


def test_fallbacks(spark):
    assert kinds(spark, "head\n1. first point\n2. second") == [("numbered", "1. first point"), ("numbered", "2. second")]
    assert kinds(spark, " prose only ") == [("whole", "prose only")] and kinds(spark, None) == [] and kinds(spark, " \n ") == []
    assert len(kinds(spark, "1. (A) x\n" * 3000)) == 3000


def test_fragments(spark):
    whole = "1. 98.226D: one\n1. a point\n270. of the Code"
    assert one(spark, B.fragments, whole) == [whole]
    assert one(spark, B.fragments, "1. 98.226D: one\nACTION: Approved\n2. 98.227D: two\nACTION: Denied") == ["1. 98.226D: one\nACTION: Approved", "2. 98.227D: two\nACTION: Denied"]
    severed = "1. 98.226D: one\n2. BRIEFING\nACTION: Approved"
    assert one(spark, B.fragments, severed) == [severed]
    assert one(spark, B.fragments, "prose\n2. BRIEFING x") == ["prose", "2. BRIEFING x"] and one(spark, B.fragments, None) == [""]


def test_decisions(spark):
    two = "Case\nACTION: Adopted\nAYES: Lee\nRESOLUTION No. 17001\nACTION: Approved\nMOTION: 17002"
    assert one(spark, B.decisions, two) == ["Case\nACTION: Adopted\nAYES: Lee\nRESOLUTION No. 17001", "ACTION: Approved\nMOTION: 17002"]
    failed = "Case\nACTION: Failed\nACTION: Approved\nMOTION: 17002"
    assert one(spark, B.decisions, failed) == [failed]
    three = "Case\nACTION: a\nMOTION: 101\nACTION: failed\nACTION: b\nMOTION: 102\nACTION: c\nMOTION: 103"
    assert one(spark, B.decisions, three) == ["Case\nACTION: a\nMOTION: 101\nACTION: failed", "ACTION: b\nMOTION: 102", "ACTION: c\nMOTION: 103"]
    assert one(spark, B.decisions, "satisfaction: no\nMOTION 12") == ["satisfaction: no\nMOTION 12"]


def test_resplit_keeps_ids_and_order(spark):
    two = "ACTION: a\nMOTION: 101\nACTION: b\nMOTION: 102"
    df = spark.createDataFrame([("d", 7, 0, two, "x"), ("d", 8, 1, "one", "y"), ("e", 9, 0, None, "z")], "doc string, id int, place int, t string, date string")
    got = B.resplit(df, "doc", "id", "place", "t", B.decisions, ("date",)).orderBy("doc", "place").collect()
    assert [(r.doc, r.id, r.parent, r.place, r.date) for r in got] == [("d", 7, 7, 0, "x"), ("d", None, 7, 1, "x"), ("d", 8, 8, 2, "y"), ("e", 9, 9, 0, "z")]
