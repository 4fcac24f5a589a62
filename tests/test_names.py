"""The reduction of names over rolls, and bare surnames within a meeting."""

from panelspark.operators import names as N


def rolls(spark, *meetings):
    rows = [(m, side, i, n) for m, (present, absent, _) in enumerate(meetings) for side, names in (("present", present), ("absent", absent)) for i, n in enumerate(names)]
    chairs = [(m, chair) for m, (_, _, chair) in enumerate(meetings)]
    return spark.createDataFrame(rows, "meeting long, side string, place int, name string"), spark.createDataFrame(chairs, "meeting long, name string")


BOTH = (["Sue Lee", "William L. Lee", "Michael Antonini"], [], "Sue Lee")


def settled(spark, *meetings):
    got = N.settled(*rolls(spark, BOTH, BOTH, BOTH, *meetings)).orderBy("meeting", "side", "place").collect()
    return [(r.side, r.person) for r in got if r.meeting > 2]


def test_bare_surnames_within_a_meeting(spark):
    got = settled(
        spark,
        (["Lee", "Lee"], [], ""),  # both on one roll
        (["Lee", "Antonini"], [], "Lee"),  # the one who presides
        (["Sue Lee"], ["Lee"], ""),  # the other one is named
        (["W. Lee"], ["Lee"], ""),
        (["Lee"], [], "Antonini"),  # nothing says who
    )
    assert got == [
        ("present", "Sue Lee"), ("present", "William L. Lee"), ("present", "Sue Lee"), ("present", "Antonini"), ("absent", "William L. Lee"), ("present", "Sue Lee"),
        ("absent", "Sue Lee"), ("present", "William L. Lee"), ("present", "Lee"),
    ]


def test_one_printing_is_no_second_person(spark):
    got = settled(spark, (["Kevin Hughes", "Alexander Hughes"], [], ""), (["Kevin Hughes"], [], ""))
    assert [p for _, p in got] == ["Hughes", "Hughes", "Hughes"]


def test_suffix_forms_are_one_person(spark):
    got = settled(spark, *[(["Shelley Bradford Bell", "Bradford Bell", "Commissioner Bradford-Bell", "Bell"], [], "")] * 2)
    assert {p for _, p in got} == {"Bell"}


def test_mojibake_titles_and_blanks(spark):
    got = settled(spark, *[(["????? Theoharis", "Anita Theoharis", "Ms. Salinas ?", "??", "", None, "President Lee"], [], "")] * 2)
    assert [p for _, p in got[:7]] == ["Theoharis", "Theoharis", "Salinas", None, None, None, "Lee"]


def test_empty(spark):
    assert N.settled(*(d.limit(0) for d in rolls(spark, BOTH))).count() == 0


def test_roster_of_clients(spark):
    """The query against plain Python: who shares a surname, over the smallest tables."""
    import re
    from collections import Counter, defaultdict

    from panelspark.queries.reading import roster_names

    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/clients.parquet").collect() if r.name is not None and r.city is not None]
    newest = {}
    for r in rows:
        newest[r.city] = max(newest.get(r.city, ()), ((r.updated_at is not None, r.updated_at or 0), r.client_id, r.name))
    words = lambda n: re.sub(r"\s+", " ", n).strip().split(" ")
    seen, forms = Counter(), defaultdict(Counter)
    for n in [r.name for r in rows] + [v[2] for v in newest.values()]:
        w = words(n)
        if len(w) > 1:
            seen[w[-1].lower(), w[0][0].upper()] += 1
            if len(w[0].replace(".", "")) > 1:
                forms[w[-1].lower(), w[0][0].upper()][" ".join(w)] += 1
    shared = {s for s in {s for s, _ in seen} if sum(n > 1 for (x, _), n in seen.items() if x == s) > 1}
    told = Counter()
    for r in rows:
        w = words(r.name)
        told[w[-1].lower() in shared and len(w) > 1] += 1
    got = {r.full: r.n for r in roster_names(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: n for k, n in told.items() if n}
