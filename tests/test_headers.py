"""The ten fields of a meeting, layout by layout."""

from pyspark.sql import functions as F

from panelspark.functions import headers as H


def read(spark, window, date="", wide=None):
    return spark.createDataFrame([(window, date, wide)], "w string, d string, x string").select(H.fields(F.col("w"), F.col("d"), F.col("x")).alias("f")).first().f


REGULAR = """PLANNING COMMISSION
ABSENT: Martin
City Hall, Room 400
Thursday, March 3, 2005
1:30 PM
Regular Meeting
COMMISSIONERS PRESENT: Sue Lee; S. Antonini,
VP Alexander and WILLIAMS
COMMISSIONER ABSENT: Hughes
THE MEETING WAS CALLED TO ORDER BY PRESIDENT BRADFORD
BELL AT 1:38 p.m.
STAFF IN ATTENDANCE: Larry Roe - Director of Planning; Ann
MCGARRY, Zoning Administrator; Linda Avery – Commission Secretary
A. CONSIDERATION OF ITEMS PROPOSED FOR CONTINUANCE"""


def test_regular(spark):
    f = read(spark, REGULAR, "Thursday, March 3, 2005")
    assert (f.meeting_type, f.meeting_time, f.location, f.presiding) == ("regular", "1:30 PM", "City Hall", "Bradford Bell")
    assert f.present == ["Sue Lee", "S. Antonini", "Alexander", "Williams"] and f.absent == ["Hughes"]
    assert f.staff == ["Larry Roe - Director of Planning", "Ann McGarry - Zoning Administrator", "Linda Avery - Commission Secretary"]
    assert (f.joint_body, f.joint_body_present, f.notes) == ("", [], "")


def test_titles_beside_names(spark):
    f = read(spark, "Thursday, May 7, 1998\nSpecial Off-Site Meeting\nPRESENT: Hector Chin, President, Anita Theo, Vice President, Dennis Ante\nABSENT: None\n")
    assert f.meeting_type == "special" and f.presiding == "Hector Chin" and f.absent == []
    assert f.present == ["Hector Chin", "Anita Theo", "Dennis Ante"]
    assert read(spark, "CALLED TO ORDER BY ACTING CHAIR FONG AT 12:20 P.M.").presiding == "Fong" and read(spark, "CALLED TO ORDER AT 12:20 P.M.").meeting_time == "12:20 PM"


def test_joint(spark):
    text = "PLANNING COMMISSION\nAND\nBUILDING INSPECTION COMMISSION\nSpecial Meeting\nThursday, April 12, 2018\nPLANNING COMMISSIONERS PRESENT: President Olague, Miguel\nBUILDING INSPECTION COMMISSION:\nCOMMISSIONERS PRESENT: President Tierney, Melara, M.S.W.\nCALLED TO ORDER BY PRESIDENT TIERNEY AT 9:00 a.m."
    f = read(spark, text, "Thursday, April 12, 2018")
    assert (f.meeting_type, f.joint_body, f.presiding) == ("joint", "Building Inspection Commission", "Olague")
    assert f.present == ["Olague", "Miguel"] and f.joint_body_present == ["Tierney", "Melara"]
    other = text.replace("President Olague", "Olague")
    assert read(spark, other, "Thursday, April 12, 2018").presiding == ""


def test_places_and_wide_rolls(spark):
    assert read(spark, "Mission High School - Auditorium\n3750 18th Street\nThursday, May 7, 1998\n", "Thursday, May 7, 1998").location == "Mission High School, 3750 18th Street"
    assert read(spark, "x\nThursday\nvia video and teleconference\n", "Thursday").location == "Remote hearing"
    f = read(spark, "Thursday\n1:30 PM\n", "Thursday", "Thursday\nboilerplate\nPRESENT: Lee, Wu\nSTAFF: A. Roe\n\nB. Doe")
    assert f.present == ["Lee", "Wu"] and f.staff == ["A. Roe"]


def test_lists_that_run_on(spark):
    f = read(spark, 'PRESENT: Mills ABSENT" Ante, ??????, Cleveland-Knowles\n1. item\nAYES: Lee')
    assert f.present == ["Mills", "Cleveland-Knowles"]


def test_nothing(spark):
    for w in (None, "", "prose " * 20000):
        f = read(spark, w, None)
        assert not any(f[c] for c in f.__fields__)
