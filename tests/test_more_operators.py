import difflib  # noqa: F401
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.functions import keys as K
from panelspark.functions import parsing as P
from panelspark.functions import textops as T
from panelspark.operators import evaluation as E
from panelspark.operators import joins as J
from panelspark.operators import spatial as G
from panelspark.operators import windows as W
from panelspark.queries import evaluating


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("100 North Point Street", "100 North Point Street"), ("2345 West Portal Avenue, north side between A and B", "2345 West Portal Avenue"), ("1 Main St at the corner of 2nd", "1 Main St"), ("5 Oak ; ", "5 Oak"), (None, None)])
def test_address_core(spark, text, want):
    assert one(spark, text, K.address_core(K.F.col("x"))) == want


@pytest.mark.parametrize(("text", "want"), [("Commissioner Jane Roe", "Jane Roe"), ("Mr. John  Q Public (M)", "(M) John Q. Public"), ("(f) Ann Lee (sponsor).", "(F) Ann Lee")])
def test_clean_name(spark, text, want):
    assert one(spark, text, K.clean_name(K.F.col("x"))) == want


@pytest.mark.parametrize(("text", "want"), [("three (3) years or 36 months", [36.0, 36.0]), ("eighteen months; ten years", [18.0, 120.0]), ("two weeks, 5 days", []), ("twenty-four months", [24.0])])
def test_durations(spark, text, want):
    assert one(spark, text, T.durations(T.F.col("x"))) == want


def test_permit_forms_and_their_guard(spark):
    text = "permit 2005.01.02.1234, 2005/0102/1234 and 200501021234; BPA No. 9812345; complaint on a permit No. 9899999"
    got = one(spark, text, P.permit_numbers(P.F.col("x")))
    assert [tuple(p) for p in got] == [("200501021234", "YYYY.MM.DD.NNNN"), ("9812345", "seven-digit")]


def test_as_of_joins_against_all_pairs(spark):
    r = random.Random(2)
    day = lambda: f"2020-01-{r.randrange(1, 20):02d}" if r.random() < 0.9 else None
    left = [(i, r.choice([1, 2, None]), day()) for i in range(40)]
    right = [(r.choice([1, 2, 3, None]), day(), r.choice(["a", "b", None])) for _ in range(30)]
    l = spark.createDataFrame(left, "id int, k int, at string").withColumn("at", J.F.to_date("at"))
    q = spark.createDataFrame(right, "k int, day string, v string").withColumn("day", J.F.to_date("day"))
    got = {x.id: (x["next"] and str(x["next"]), x["last"] and str(x["last"])) for x in J.next_event(l, q, ["k"], "at", "day").collect()}
    before = {x.id: x.v for x in J.latest_before(l, q, ["k"], "at", "day", "v").collect()}
    for i, k, at in left:
        mine = [(d, v) for kk, d, v in right if kk is not None and kk == k]
        days = [d for d, _ in mine if d]
        assert got[i] == (min((d for d in days if at and d >= at), default=None), max(days, default=None)), i
        fits = [(d or "", v or "") for d, v in mine if d is None or (at and d <= at)]
        assert (before[i] or "") == max(fits, default=("", ""))[1], i
    for how in ("inner", "left_semi", "left_anti"):
        found = J.interval_join(l, q, ["k"], "at", "day", 3, 2, how).collect()
        pairs = Counter(i for i, k, at in left for kk, d, _ in right if k is not None and kk == k and at and d and -3 <= int(d[-2:]) - int(at[-2:]) <= 2)
        ids = Counter(x.id for x in found)
        assert ids == (pairs if how == "inner" else Counter({i: 1 for i in pairs}) if how == "left_semi" else Counter({i: 1 for i, *_ in left if i not in pairs}))


def test_short_terms_are_absorbed(spark):
    assert W.absorb([["a", 1, 5, 5], ["b", 6, 6, 1], ["a", 7, 9, 3]], 3) == [["a", 1, 9, 9]]
    assert W.absorb([["a", 1, 2, 2], ["b", 3, 9, 7]], 3) == [["b", 1, 9, 9]]
    assert W.absorb([["a", 1, 1, 1]], 3) == [["a", 1, 1, 1]]
    e = spark.createDataFrame([(1, i, "x" if i < 6 or i == 8 else "y") for i in range(14)], "u int, t int, v string")
    got = [(r.term, r["name"], r.start, r.end, r.n) for r in W.terms(e, "u", ["t"], "v", "t", 2, 3).orderBy("term").collect()]
    values = ["x" if i < 6 or i == 8 else "y" for i in range(14)]
    modes = [Counter(values[max(0, i - 2) : i + 3]).most_common(1)[0][0] for i in range(14)]
    runs = []
    for i, m in enumerate(modes):
        if runs and runs[-1][0] == m:
            runs[-1][2], runs[-1][3] = i, runs[-1][3] + 1
        else:
            runs.append([m, i, i, 1])
    assert got == [(i, *x) for i, x in enumerate(W.absorb(runs, 3))]


def test_least_squares_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + x[:, 1]  # a column that follows from the others costs no degree of freedom
    y = 1 + x @ [2.0, -1.0, 0.5] + r.normal(size=200)
    df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y double, a double, b double, c double")
    _, fit = E.least_squares(df, "y", ["a", "b", "c"])
    m = np.c_[np.ones(200), x]
    sse = ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()
    sst = ((y - y.mean()) ** 2).sum()
    assert fit["n"] == 200 and fit["r2"] == pytest.approx(1 - sse / sst) and fit["sd"] == pytest.approx((sse / 197) ** 0.5) and fit["r2_adj"] == pytest.approx(1 - (sse / 197) / (sst / 199))
    ladder = evaluating.least_squares_ladder(spark, "/root/testdata/sf0.001").orderBy("step").collect()
    assert [a.r2 <= b.r2 + 1e-12 for a, b in zip(ladder, ladder[1:], strict=False)] == [True, True]


def test_rings_holes_and_clipping(spark):
    wkt = "MULTIPOLYGON(((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 20, 30 20, 30 30, 20 30, 20 20)))"
    geo = '{"type": "Polygon", "coordinates": [[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (25.0, 25.0), (15.0, 15.0)], "x double, y double")
    lit = G.F.lit
    got = df.select(G.inside_rings(G.F.col("x"), G.F.col("y"), G.rings_of_wkt(lit(wkt))).alias("w"), G.inside_rings(G.F.col("x"), G.F.col("y"), G.rings_of_geojson(lit(geo))).alias("g")).collect()
    assert [r.w for r in got] == [True, False, True, False] and [r.g for r in got] == [True, False, False, False]
    a = G.rectangle(lit(0), lit(0), lit(4), lit(4))[0]
    triangle = G.rings_of_wkt(lit("POLYGON((2 2, 8 2, 2 8, 2 2))"))[0]
    assert spark.range(1).select(G.ring_area(G.clipped(a, triangle)).alias("v")).first().v == pytest.approx(4.0)
    assert spark.range(1).select(G.F.size(G.clipped(a, G.rectangle(lit(9), lit(9), lit(10), lit(10))[0])).alias("v")).first().v == 0


@pytest.mark.parametrize(("text", "want"), [
    ("building permit No. 1234567 and No. 2345678", ["1234567", "2345678"]),
    ("building permit " + "x" * 66 + " No. 1234567", []), ("permit " + "x" * 60 + " No. 1234567", ["1234567"]),
    ("permit No. 1234567, Notice of Violation No. 2345678", ["1234567"]), ("No. 1234567", []), (None, []),
])
def test_bare_permit_numbers_look_back_in_the_whole_text(spark, text, want):
    assert [r.number for r in one(spark, text, P.permit_numbers(P.F.col("x")))] == want


@pytest.mark.parametrize(("text", "want"), [
    ("three (3) years, 36 months", [36.0, 36.0]), ("twenty-four months or thirty six (36) months", [24.0, 36.0]), ("a year; 0 years; 1,000 months; 1000 months", []),
    ("within ten years and 18 months.", [120.0, 18.0]), ("1-year", []), (None, None),
])
def test_durations_by_grammar(spark, text, want):
    assert one(spark, text, T.durations(T.F.col("x"))) == want


@pytest.mark.parametrize(("text", "want", "days"), [
    ("open 6 a.m. to 10:30 p.m. daily", (6.0, 22.5), "daily"), ("from 11 AM through 2 AM on Fridays", (11.0, 26.0), "weekday"), ("24 hours a day", (0.0, 24.0), "24 hours"),
    ("9am–5pm, Saturday and Sunday", (9.0, 17.0), "weekend"), ("9am to 5pm", (9.0, 17.0), "unspecified"), ("no hours", (None, None), None),
])
def test_hours_and_days(spark, text, want, days):
    start, end = T.hours(T.F.col("x"))
    got = spark.createDataFrame([(text,)], "x string").select(start.alias("s"), end.alias("e"), T.hours_days(T.F.col("x")).alias("d")).first()
    assert (got.s, got.e) == want and got.d == days


def test_stated_quantities(spark):
    text = "three (3) years, 1 foot, 2 foot, 10% and 1.5 percent, 9:00a.m., 8 P.M., 18 months, 1 units, class 2 spaces, 1,200 space"
    assert one(spark, text, T.stated_quantities(T.F.col("x"))) == ["3 years", "1 foot", "2 feet", "10 percent", "1.5 percent", "9:00 a.m.", "8 p.m.", "18 months", "1 unit", "1,200 spaces"]


def test_bicycles_of_all_matches_add_up(spark):
    df = spark.createDataFrame([("Bicycle Parking", "12 Class 1 bicycle spaces and two Class 2 bicycle spaces; later 3 Class 1 bicycle spaces")], "h string, b string")
    m = df.select(P.numbers_of(P.F.col("h"), P.F.col("b")).alias("m")).first().m
    assert (m.bike_class1, m.bike_class2) == (15.0, 2.0)
