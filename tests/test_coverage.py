"""Coverage of columns and tables, rolls, lists, universes and registers by hand-made cases and against brute force."""

import random

from pyspark.sql import functions as F

from panelspark.functions import registers as G
from panelspark.operators import coverage as V
from panelspark.operators import joins as J
from panelspark.operators import resolvers as R
from panelspark.operators import rules as U


def test_profile(spark):
    rows = [("1980", "Y", "2001-01-02T00:00:00", 7, "POINT (1 2)", None, "a"), ("1980", "Y", "2001-01-02T05:00:00", 8, "POINT (1 3)", " ", "b"), ("1990", None, "2001-01-01T00:00:00", 8, None, None, None), (None, "Y", None, None, None, None, "b")]
    df = spark.createDataFrame(rows, "era string, yes string, day string, lot_no int, place string, void string, word string").withColumnRenamed("word", ":word")
    got = {r["column"]: r for r in V.profile(df, ["yes", "day", "lot_no", "place", "void", ":word"], F.col("era")).collect()}
    assert {c: r.kind for c, r in got.items()} == {"yes": "flag", "day": "date", "lot_no": "code", "place": "geometry", "void": "text", ":word": "system"}
    assert got["day"].examples == "2001-01-02; 2001-01-01" and got["day"].n_distinct == 3 and got["yes"].note == "one value: Y"
    assert (got["void"].n, got["void"].n_filled, got["void"].n_distinct, got["void"].examples, got["void"].note) == (4, 0, 0, "", "hardly filled")
    assert got[":word"].note == "0.0% in 1990, 100.0% in 1980" and got[":word"].examples == "b; a" and got["lot_no"].populated == 0.75
    eras = {(r["column"], r.period): (r.n, r.n_filled) for r in V.populated_by(df, ["yes", ":word"], F.col("era")).collect()}
    assert eras == {("yes", "1980"): (2, 2), ("yes", "1990"): (1, 0), ("yes", "none"): (1, 1), (":word", "1980"): (2, 2), (":word", "1990"): (1, 0), (":word", "none"): (1, 1)}
    empty = V.profile(df.limit(0), ["yes"], F.col("era")).collect()
    assert [(r["column"], r.kind, r.n, r.populated) for r in empty] == [("yes", "text", 0, None)]


def test_set_coverage_against_brute_force(spark):
    rng = random.Random(3)
    lot = lambda: rng.choice([None, f"{rng.randrange(6):04d}{rng.randrange(9)}"])
    layer = [(lot(), lot(), rng.choice(["0001", "0002", "0005", None]), rng.choice([True, False, None])) for _ in range(25)]
    items = [(i, lot()) for i in range(60) for _ in range(rng.randrange(1, 5))]
    tests = {"hit": ("lot", F.lit(True)), "mapped": ("map", F.lit(True)), "active": ("lot", F.col("on"))}
    got = {r.id: tuple(r)[1:] for r in V.set_coverage(spark.createDataFrame(items, "id int, e string"), "id", "e", spark.createDataFrame(layer, "lot string, map string, block string, on boolean"), tests).collect()}
    lots, maps, live, blocks = {a for a, *_ in layer if a}, {b for _, b, *_ in layer if b}, {a for a, _, _, on in layer if a and on}, {c for _, _, c, _ in layer if c}
    for i in range(60):
        mine = {e for k, e in items if k == i and e}
        hit = bool(mine & lots)
        assert got[i] == (bool(mine), hit, bool(mine & maps), bool(mine & live), not hit and bool({e[:4] for e in mine} & blocks))


def test_risk_steps_against_brute_force(spark):
    rng = random.Random(8)
    panel = [(u, y, rng.choice([True, False, None]), rng.choice([True, True, False])) for u in range(30) for y in range(4)]
    events = [(rng.choice([None, *range(35)]), rng.choice([None, 0, 1, 2, 3, 9])) for _ in range(80)]
    p = spark.createDataFrame(panel, "u int, y int, a boolean, b boolean")
    got = [tuple(r) for r in V.risk_steps(p, "u", "y", [("all", F.lit(True)), ("a", F.col("a")), ("b", F.col("b"))], spark.createDataFrame(events, "u int, y int")).orderBy("step").collect()]
    kept, lost, want = [panel, [r for r in panel if r[2]], [r for r in panel if r[2] and r[3]]], None, []
    for i, (rule, rows) in enumerate(zip(("all", "a", "b"), kept, strict=True)):
        n = len({(u, y) for u, y, *_ in rows} & set(events))
        want.append((i, rule, len({r[0] for r in rows}), len(rows), n, 0 if lost is None else lost - n, 10000 * n / len(rows)))
        lost = n
    assert got == want
    empty = V.risk_steps(p.limit(0), "u", "y", [("all", F.lit(True))], spark.createDataFrame([], "u int, y int")).collect()
    assert [tuple(r) for r in empty] == [(0, "all", 0, 0, 0, 0, None)]


def test_items_kept(spark):
    panel = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, None)], "u int, y int, a boolean")
    items = spark.createDataFrame([("i", "x", 1, 1), ("i", "x", 2, 1), ("j", None, 2, 1), ("k", "x", 1, 2), ("l", "x", 9, 9), ("m", "x", None, 1)], "id string, kind string, u int, y int")
    assert {(r.kind, r.in_panel, r.kept) for r in V.items_kept(items, "id", "kind", "u", "y", panel, F.col("a")).collect()} == {("x", 2, 1), ("(blank)", 1, 0)}


def test_cases_by_three_tests(spark):
    cases = spark.createDataFrame([(1, "98.1A", "1998.1A", "1998.1"), (2, "", "", ""), (3, None, None, None), (4, "2001.7", "2001.7", "2001.7")], "id int, p string, k string, s string")
    records = spark.createDataFrame([("2001.7", "2001.7", "2001.7"), ("r", "1998.1D", "1998.1"), ("", "", ""), (None, None, None), ("r2", "1998.1E", "1998.1")], "a string, b string, c string")
    got = {r.id: (r.j_raw, r.j_key, r.j_stem, r.j_any) for r in V.case_tests(cases, "p", "k", "s", records, "a", "b", "c").collect()}
    assert got == {1: (False, False, True, True), 2: (False,) * 4, 3: (False,) * 4, 4: (True,) * 4}
    short = spark.createDataFrame([(1, "98", ".1D"), (2, "05", ".9"), (3, None, ".1D"), (4, "77", ".1")], "id int, yy string, rest string")
    known = spark.createDataFrame([("1998.1D",), ("2098.1D",), ("2005.9",)], "b string")
    assert {(r.id, r.centuries) for r in V.other_century(short, "id", F.col("rest"), F.col("yy"), known, "b").collect()} == {(1, 2), (2, 1), (3, 0), (4, 0)}


def test_tiers_of_a_roll(spark):
    roll = spark.createDataFrame([("a", 1, "d1", "x", 10), ("a", 1, "d2", "x", 11), ("a", 2, "d2", "y", 12), ("b", 1, "d3", "x", 13), ("c", 1, "d4", "x", 14), ("c", 2, "d4", "y", 15), ("c", 3, "d4", "y", 16)], "s string, o int, d string, t string, id int")
    left = spark.createDataFrame([(1, "a", 1, "d3", None), (2, "a", 9, "d2", None), (3, "z", None, "d3", None), (4, "z", None, "d4", "x"), (5, "z", None, "d4", "y"), (6, None, None, None, None), (7, "z", 1, "d2", "y")], "k int, s string, o int, d string, t string")
    got = {r.k: (r.how, r.id) for r in R.of_roll(left, roll, "s", "o", "d", "t", ["id"], "id").collect()}
    assert got == {1: ("ordinal", 10), 2: ("date", 11), 3: ("only", 13), 4: ("token", 14), 5: ("none", None), 6: ("none", None), 7: ("token", 12)}


def test_rules_of_a_list(spark):
    rules = [("^Tier 1 for", "t1", "by height"), ("^Tier (1|one)", "t1", ""), ("^Tier 2$", "t2", ""), ("Park", "park", "a lower bound")]
    df = spark.createDataFrame([(1, "Tier 2; Tier 1; Tier 1 for all"), (2, "Tier 22; nothing"), (3, None), (4, ""), (5, "Park (x) ; Park|y")], "k int, l string")
    got = {r.k: (r.labels, r.notes) for r in J.rules_of_list(df, "l", rules).collect()}
    assert got == {1: (["t1", "t2"], ["by height"]), 2: ([], []), 3: ([], []), 4: ([], []), 5: (["park"], ["a lower bound"])}


def test_universe(spark):
    rows = [(i, "alt", float(i), 2000) for i in range(1, 21)] + [(21, "new", 1.0, 2000), (22, "alt", 5.0, None), (23, None, 99.0, 2000), (24, "alt", None, 2001), (25, "alt", 3.0, 2001)]
    df = spark.createDataFrame(rows, "id int, kind string, cost double, year int")
    of = F.col("kind") == "alt"
    got = U.universe(df, {"new": F.col("kind") == "new"}, "dear", of, "cost", "year", 0.9)
    assert got.count() == 25 and {r.id for r in got.where("dear").collect()} == {19, 20, 25} and {r.id for r in got.where("in_universe").collect()} == {19, 20, 21, 25}
    assert {r.id for r in U.universe(df, {}, "dear", of, "cost", "year", nominal=18.0).where("in_universe").collect()} == {18, 19, 20}


def test_fee_bands_and_labels(spark):
    said = ["21-99 Units", ">99,999 gsf", "<10 units", "≥5 sq. ft", "Hospitals", None, "800–99,999 gsf", "≤ 7 units", "10 to 20 square feet", ">5 units, 6-9 units"]
    got = [tuple(r.b) for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", G.fee_band(F.col("s")).alias("b")).orderBy("i").collect()]
    none = (None, None, None)
    assert got == [(21, 99, "units"), (99999, None, "gsf"), (None, 10, "units"), (5, None, "sq. ft"), none, none, (800, 99999, "gsf"), (None, 7, "units"), (10, 20, "square feet"), (5, None, "units")]
    leads = [">99 Units: ", "Hospitals:", "the fee is ", "Retail $3 PLUS office ", "Non-Residential", "", None]
    labels = [r.l for r in spark.createDataFrame([(i, s) for i, s in enumerate(leads)], "i int, s string").select("i", G.rate_label(F.col("s")).alias("l")).orderBy("i").collect()]
    assert labels == [">99 Units", "Hospitals", "", "office", "Non-Residential", "", ""]


def test_register(spark):
    page = """Register of 2020 $9.99 per unit
Transit fee Planning Code
Section 411A $7.74 per gsf
21-99 Units: $8.13 per gross sq. ft. >99 Units: $9.20 / gsf
Hospitals:
$28.14 per gross square foot
Child care Planning Code Section 414 $1,000.50
School fee State Ed. Code Section 17620 Residential $3.48/sq. ft."""
    df = spark.createDataFrame([("p", page), ("none", "no code here $5 per unit"), ("null", None), ("", "")], "id string, text string")
    got = [(r.block, r.section, r.label, r.rate, r.unit) for r in G.register_rates(df, "id", "text").orderBy("block", "line", "nth").collect()]
    assert got == [
        (1, "411A", "", 7.74, "gsf"), (1, "411A", "21-99 Units", 8.13, "gross sq. ft."), (1, "411A", ">99 Units", 9.20, "gsf"), (1, "411A", "Hospitals", 28.14, "gross square foot"),
        (2, "414", "", 1000.50, ""), (3, "EdCode", "Residential", 3.48, "sq. ft."),
    ]
    assert "Exchange" not in G.register_rates(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
