"""A test for each transition of the reading of conditions."""

from panelspark.operators import conditions as C


def read(spark, *pages, bold=()):
    rows = [(1, p, i, said, said in bold) for p, page in enumerate(pages) for i, said in enumerate(page)]
    df = spark.createDataFrame(rows, "key long, page int, line int, said string, bold boolean")
    return C.conditions(df).orderBy("section", "ordinal").collect()


HEAD = ["Planning Commission Motion No. 18915", "Case No. 2012.0123C", "Exhibit A"]


def test_numbered_and_named(spark):
    got = read(spark, [*HEAD, "AUTHORIZATION", "This authorization is for a use.", "PERFORMANCE", "1. Validity. The right is valid", "for three years.", "For information about compliance, contact Code Enforcement,", "www.example.org", "2. Expiration. It lapses.", "3. this one has no name"])
    assert [(r.no, r.heading, r.section_heading, r.implicit) for r in got] == [(None, "", "AUTHORIZATION", True), ("1", "Validity", "PERFORMANCE", False), ("2", "Expiration", "PERFORMANCE", False), ("3", "", "PERFORMANCE", False)]
    assert got[1].body == "The right is valid for three years." and got[1].compliance_contact == "Code Enforcement, www.example.org" and got[2].compliance_contact == ""
    assert [r.confidence for r in got] == ["low", "high", "high", "medium"] and {r.number for r in got} == {"18915"}


def test_numbers_of_lists_inside_do_not_start(spark):
    got = read(spark, [*HEAD, "1. One. a", "2. Two. b", "3. Three. c", "4. Four. d", "5. Five. e", "6. Six. f", "2. an entry of a list", "9. nine", "30. thirty"])
    assert [(r.no, r.sequence_gap) for r in got] == [("1", False), ("2", False), ("3", False), ("4", False), ("5", False), ("6", False), ("9", True)]
    assert got[5].body.endswith("an entry of a list") and got[6].body.endswith("thirty") and got[6].confidence == "low"


def test_restarts_at_one(spark):
    assert [r.no for r in read(spark, [*HEAD, "1. A b.", "2. C d.", "3. E f.", "1. G h.", "2. I j."])] == ["1", "2", "3", "1", "2"]


def test_parens_letters_and_bold(spark):
    assert [(r.style, r.no) for r in read(spark, [*HEAD, "(1) one", "(2) two", "(3) three"])] == [("paren", "1"), ("paren", "2"), ("paren", "3")]
    assert [(r.style, r.no, r.body) for r in read(spark, [*HEAD, "A. one", "and more", "B. two", "C. three"])] == [("lettered", "A", "one and more"), ("lettered", "B", "two"), ("lettered", "C", "three")]
    got = read(spark, [*HEAD, "OPERATION", "Noise.", "Keep quiet.", "Odor Control.", "Filter the air."], bold=("Noise.", "Odor Control."))
    assert [(r.style, r.no, r.heading, r.body) for r in got] == [("bold_heading", None, "Noise", "Keep quiet."), ("bold_heading", None, "Odor Control", "Filter the air.")]


def test_exhibit_ends(spark):
    tail = ["1. A b.", "2. C d.", "3. E f."]
    for end in ("Exhibit B", "Re: your letter", "Dear Ms. Wu,"):
        assert len(read(spark, [*HEAD, *tail, end, "4. G h."])) == 3
    assert read(spark, tail) == []
    got = read(spark, [*HEAD, *tail, "Motion No. 18916", "4. not in an exhibit", "Conditions of Approval", *tail])
    assert [(r.section, r.number, r.no) for r in got] == [(1, "18915", "1"), (1, "18915", "2"), (1, "18915", "3"), (2, "18916", "1"), (2, "18916", "2"), (2, "18916", "3")]


def test_running_heads_and_page_numbers_go(spark):
    pages = [[*HEAD, "1. A b.", "Page 1 of 4"], ["Motion No. 18915 of May 5", "2. C d.", "2"], ["Motion No. 18915 of May 5", "3. E f.", "iii"], ["Motion No. 18915 of May 5", "4. G h."]]
    assert [(r.no, r.heading + r.body, r.page_start) for r in read(spark, *pages)] == [("1", "A b", 0), ("2", "C d", 1), ("3", "E f", 2), ("4", "G h", 3)]


def test_parts(spark):
    got = read(spark, [*HEAD, "SEVERABILITY", "If any clause fails.", "Conditions of Approval, Compliance, Monitoring", "1. A b.", "2. C d.", "3. E f."])
    assert [(r.part, r.implicit, r.section_heading) for r in got] == [("preamble", True, "SEVERABILITY"), *[("conditions", False, "")] * 3]


def test_records(spark):
    text = "\n".join
    docs = [
        (1, text(["Draft Motion", "Motion No. 100", "Exhibit A", "1. A.", "2. B.", "3. C.", "4. D."])), (2, text(["Motion No. 100", "ADOPTED: May 5, 2010", "Exhibit A", "1. A.", "2. B.", "3. C."])),
        (3, "Record No. 2010.0044x\nnothing else"), (4, "no key"), (5, None), (6, ""), (7, "Motion No. XXXX\nCase No. 2010.0044X"),
    ]
    got = {(r.key, r.section): r for r in C.records(C.lines_of(spark.createDataFrame(docs, "doc long, text string"), "doc", "text")).collect()}
    assert got[1, 1].record_key == got[2, 1].record_key == "motion 100" and not got[1, 1].canonical and got[2, 1].canonical and got[2, 1].adopted == "May 5, 2010"
    assert (got[3, 0].record_key, got[3, 0].canonical, got[7, 1].record_key, got[7, 1].canonical) == ("case 2010.0044X", True, "case 2010.0044X", False)
    assert got[4, 0].record_key == "document/4/0" and got[7, 1].draft and {k for k, _ in got} == {1, 2, 3, 4, 7}
    assert (got[1, 1].n_conditions, got[2, 1].n_conditions) == (4, 3)
