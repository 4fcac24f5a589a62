"""Fields of an item's block, case by case."""

import pytest
from pyspark.sql import functions as F

from panelspark.functions import itemfields as I

BLOCK = """5.  2015-006317CUA                         (J. SMITH: (415) 575-6925)
 1650 MISSION STREET - north side; Lots 9, 20A in Assessor's Block 3512 in an NC-3 (Moderate Scale
Neighborhood Commercial) District and a 85-X Height District.
Request for Conditional Use under the Motion No. 17518
conditions of approval. (Proposed for Continuance to June 20, 2024)
Preliminary Recommendation: Approve with Conditions
SPEAKERS: + Ann Roe - project sponsor
- Bo Lee, Cy Wu
(+/-) Di Ito
= Ed Ng
Fay
ACTION: Continued to 7/4/24
AYES: Lee, Wu and Roe
NOES: None
ABSENT: Moore
MOTION: 20111"""


def values(spark, block):
    return spark.createDataFrame([(block,)], "b string").select(I.fields(F.col("b")).alias("f")).first().f


def test_block(spark):
    f = values(spark, BLOCK)
    assert (f.case_number, f.request_type, f.assessor_block, f.lot_number) == ("2015-006317CUA", "conditional_use", "3512", "9, 20A")
    assert (f.type_district, f.type_district_descr, f.height_and_bulk_district, f.project_address) == ("NC-3", "moderate scale neighborhood commercial", "85-X", "1650 Mission Street")
    assert f.project_descr == "Request for Conditional Use under the Motion No. 17518 conditions of approval." and f.staff_planner == "J. Smith"
    assert (f.preliminary_recommendation, f.preliminary_recommendation_category, f.action, f.continued_to) == ("Approve with Conditions", "approve", "continued", "2024-07-04")
    assert [(s.name, s.stance) for s in f.speakers] == [("Ann Roe", "support"), ("Bo Lee", "oppose"), ("Cy Wu", "oppose"), ("Di Ito", "neutral"), ("Ed Ng", "neutral"), ("Fay", "")]
    assert (f.support_count, f.oppose_count, f.neutral_count) == (1, 2, 2) and f.conditions_imposed == "" and f.project_modified == ""
    assert (f.ayes, f.noes, f.absent, f.recused) == (["Lee", "Wu", "Roe"], [], ["Moore"], [])
    assert (f.action_instrument, f.action_instrument_no) == ("motion", 17518)


@pytest.fixture(scope="module")
def read(spark):
    def many(f, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x"))
        return [r.x for r in df.orderBy("i").collect()]

    return many


def test_decisions_in_order(read):
    want = {
        "Adopted a Motion of Intent to Disapprove": "intent_to_disapprove", "Intent to approve": "intent_to_approve", "Did not take DR and approved": "did_not_take_dr", "No DR": "did_not_take_dr", "Took Discretionary Review and approved": "took_dr_and_approved",
        "Took DR": "took_dr", "Continued indefinitely": "continued_indefinitely", "Continued": "continued", "Withdrawn": "withdrawn", "Motion to Approve with Conditions FAILED": "motion_failed", "Disapproved": "disapproved", "Approved as amended": "approved", "Adopted": "adopted",
        "Certified": "certified", "Upheld": "upheld", "Initiated and scheduled a hearing": "initiated", "None - Informational": "no_action", "No action": "no_action", "Heard": "other", "": "",
    }
    assert read(lambda t: I._of(I.DECISIONS, t), list(want)) == list(want.values())
    advice = {"Pending": "pending", "Certify the Final EIR": "certify_eir", "Uphold the Negative Declaration": "uphold_neg_dec", "Do not take Discretionary Review and approve": "did_not_take_dr", "Take Discretionary Review and approve": "took_dr_and_approved", "Take DR": "other", "Disapprove": "disapprove", "Approve": "approve", "Adopt CEQA findings": "adopt", "Initiate": "initiate", "": ""}
    assert read(lambda t: I._of(I.ADVICE, t), list(advice)) == list(advice.values())


def test_action_stands_at_the_start_of_a_line(read):
    assert read(lambda t: I.fields(t)["action"], ["the attraction: Approved", "x\n  ACTION: Approved\nAYES: a", "ACTION: No Action is required", None, "", "word " * 30000]) == ["", "approved", "no_action", "", "", ""]
    assert read(lambda t: I.fields(t)["conditions_imposed"], ["ACTION: Approved\nsubject to the following conditions", "conditions of approval\nACTION: Approved", "ACTION: Approved with Conditions as modified", "ACTION: Continued\nconditions of approval"]) == ["yes", "", "yes", ""]


def test_cases_and_dates(read):
    texts = ["12.2015-006317CUA", "1650-1680 Mission", "2007.0619.4378 x", "98.226D: y", "2004. 0164D", "2006.1052E T, District", "2003.0672XL"]
    assert read(lambda t: I.fields(t)["case_number"], texts) == ["2015-006317CUA", "", "", "98.226D", "2004.0164D", "2006.1052ET", "2003.0672XL"]
    assert read(I.request_of, ["2015-006317CUA", "98.226D", "2006.1052ET", "2015-1234DRP", "2015-1234", "2003.0672QL", ""]) == ["conditional_use", "discretionary_review", "ceqa_environmental", "discretionary_review", "", "historic", ""]
    assert read(lambda t: I.fields(t)["continued_to"], ["ACTION: Continued to April 21, 2005", "(Proposed for Continuance to 3/12/98)", "continued indefinitely", "to June"]) == ["2005-04-21", "1998-03-12", "indefinite", ""]
