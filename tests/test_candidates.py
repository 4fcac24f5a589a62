"""Keys of records by hand; scores of boundaries by hand and against brute force."""

import random

from panelspark.operators import candidates as C
from panelspark.operators import positions as P


def test_case_keys(spark):
    df = spark.createDataFrame([("2015-004568CUA", "2015-4568 CUA"), ("2015-004568CUA", "2015-4568 CUA"), ("2015-004568VAR", None), ("98.226", "98.226"), ("odd", "odd"), ("", "x"), (None, "y")], "cn string, raw string")
    got = C.case_keys(df, "cn", "raw").collect()
    by = {}
    for r in got:
        by.setdefault(r.case, set()).add(r.variant)
    stem = {"2015-004568", "2015-004568CUA", "2015-004568VAR"}
    assert by == {"2015-004568CUA": stem | {"2015-4568 CUA"}, "2015-004568VAR": stem, "98.226": {"98.226"}, "odd": {"odd"}} and len(got) == sum(map(len, by.values()))


def test_instruments_and_places(spark):
    df = spark.createDataFrame([("0101", "motion", 2001), ("101", "motion", 2002), ("202", "resolution", 1999), ("12", "motion", 2000), ("000", "motion", 2000), ("303", None, None), ("x1", "motion", 2000)], "n string, i string, y int")
    got = C.instrument_keys(df, "n", "i", "y")
    assert sorted(map(tuple, got.collect())) == [("101", "101", y) for y in (2000, 2001, 2002, 2003)] + [("202", f, y) for f in ("202", "R202") for y in (1998, 1999, 2000)]
    places = C.candidates(got.where("number = '202'"), "number", "form", {"year": ("m/{year}/{form}.pdf", False)})
    assert sorted(r.place for r in places.collect()) == sorted(f"m/{y}/{f}.pdf" for f in ("202", "R202") for y in (1998, 1999, 2000))
    keys = spark.createDataFrame([("a", "98.1D"), ("b", "98.1")], "case string, variant string")
    assert sorted((r.key, r.place) for r in C.candidates(keys, "case", "variant", {"old": ("o/{variant}", True), "new": ("n/{variant}", False)}).collect()) == [("a", "n/98.1D"), ("a", "o/98.1D"), ("a", "o/98.1d"), ("b", "n/98.1"), ("b", "o/98.1")]


def brute(gold, found, tol):
    hits = 0
    for doc, date in {(d, t) for d, t, _ in gold}:
        left = sorted(p for d, t, p in found if (d, t) == (doc, date))
        for g in sorted(p for d, t, p in gold if (d, t) == (doc, date)):
            best = min(left, key=lambda p: (abs(p - g), p), default=None)
            if best is not None and abs(best - g) <= tol:
                left.remove(best)
                hits += 1
    return hits


def test_boundaries_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda n: [(rng.randrange(6), f"2001-01-0{rng.randrange(1, 4)}", rng.randrange(200)) for _ in range(n)]
    for tol in (0, 3, 25):
        gold, found = draw(80), draw(90)
        make = lambda rows: spark.createDataFrame([*rows, (None, "x", 1), (1, None, 1), (1, "x", None)], "doc int, date string, place int")
        got = {r.level: r for r in P.boundary_scores(make(gold), make(found), tol).collect()}
        docs = {d for d, _, _ in gold}
        dates = {(d, t) for d, t, _ in gold} & {(d, t) for d, t, _ in found}
        assert got["position"].hits == brute(gold, found, tol) and got["date"].hits == len(dates) and got["position"].n_gold == 80
        assert got["position"].n_found == sum(d in docs for d, _, _ in found) and got["date"].n_gold == len({(d, t) for d, t, _ in gold})
    empty = make([]).limit(0)
    assert P.boundary_scores(empty, empty, 3).count() == 0


def test_two_meetings_of_a_day(spark):
    gold = spark.createDataFrame([("a", "d", 10), ("a", "d", 900)], "doc string, date string, place int")
    got = {r.level: (r.hits, r.recall) for r in P.boundary_scores(gold, gold.where("place = 10"), 50).collect()}
    assert got == {"date": (1, 1.0), "position": (1, 0.5)}


def test_block_dates(spark):
    gold = spark.createDataFrame([("a", "d1", 10), ("a", "d2", 50), (None, "d", 1)], "doc string, date string, place int")
    blocks = spark.createDataFrame([("a", 0, 5, "d1"), ("a", 1, 10, "d1"), ("a", 2, 49, "d2"), ("a", 3, None, None), ("a", 4, 60, "d2"), ("a", 5, None, "d2"), ("b", 0, 3, "d1")], "doc string, block int, place int, date string")
    got = {(r.doc, r.block): r.want for r in P.block_dates(gold, blocks).collect()}
    assert got == {("a", 0): "d1", ("a", 1): "d1", ("a", 2): "d1", ("a", 3): "d1", ("a", 4): "d2", ("a", 5): "d2", ("b", 0): None}
