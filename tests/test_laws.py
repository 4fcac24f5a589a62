"""Inventory of laws: a pattern is inferred only where every note follows it."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import laws as L

NEXT = lambda d: F.make_date(F.year(d) + 1, F.lit(1), F.lit(1))
D = dt.date


def test_inventory(spark):
    laws = spark.createDataFrame(
        [("a", "ca", "noted", 1), ("b", "ca", "noted", 2), ("c", "ca", "noted", 3), ("d", "ca", "at_once", 4), ("e", "ny", "noted", 5), ("f", "ny", "noted", 6), ("g", "ny", "noted", 7), ("h", "sf", "listed", 8), ("i", None, "code", 9), ("j", None, "noted", 10), ("k", None, "noted", 11)],
        "law string, family string, kind string, size int",
    )
    y = lambda law, field, value, ok=True: (law, field, value, ok)
    claims = spark.createDataFrame(
        [
            y("a", "enacted", D(2017, 9, 29)), y("a", "effective", D(2018, 1, 1)),
            y("b", "enacted", D(2019, 10, 9)), y("b", "effective", D(2021, 5, 5), False),
            y("c", "effective", D(2020, 1, 1)),
            y("d", "enacted", D(2019, 6, 1)), y("d", "at_once", None),
            y("e", "enacted", D(2017, 2, 1)), y("e", "effective", D(2018, 1, 1)), y("f", "enacted", D(2017, 2, 1)), y("f", "effective", D(2017, 7, 1)), y("g", "enacted", D(2020, 3, 3)),
            y("h", "effective", D(2026, 2, 2)), y("h", "sunset", D(2027, 1, 1)), y("j", "enacted", D(2010, 1, 5)), y("j", "effective", D(2011, 1, 1)), y("k", "enacted", D(2012, 1, 5)), y("zz", "enacted", D(2000, 1, 1)),
        ],
        "law string, field string, value date, verified boolean",
    )
    inv = L.inventory(laws, claims, NEXT)
    got = {r.law: (str(r.effective), r.basis, r.verified) for r in inv.collect()}
    assert got == {
        "a": ("2018-01-01", "history note", "yes"), "b": ("2020-01-01", "inferred", "partial"), "c": ("2020-01-01", "history note", "yes"), "d": ("2019-06-01", "takes effect at once", "yes"),
        "e": ("2018-01-01", "history note", "yes"), "f": ("2017-07-01", "history note", "yes"), "g": ("None", None, "yes"), "h": ("2026-02-02", "published list", "yes"),
        "i": ("None", "code in force", "unverified"), "j": ("2011-01-01", "history note", "yes"), "k": ("2013-01-01", "inferred", "yes"),
    }
    on = lambda day: {r.law for r in inv.where(L.counts_on(F.lit(day))).collect()}
    assert "h" in on(D(2026, 12, 31)) and "h" not in on(D(2027, 1, 1)) and "g" not in on(D(2030, 1, 1)) and on(D(2011, 1, 1)) == {"j"}
    assert inv.columns[:4] == ["law", "family", "kind", "size"] and L.inventory(laws.limit(0), claims, NEXT).count() == 0


def test_quotes_are_checked_in_their_sources(spark):
    claims = spark.createDataFrame([(1, "s", "takes  effect on\nJanuary 1"), (2, "s", "never said in there"), (3, "s", "takes"), (4, "t", "takes effect on January 1"), (5, "s", None), (6, None, "takes effect on January 1")], "law int, source string, quote string")
    sources = spark.createDataFrame([("s", "This act Takes effect on January 1, 2018."), ("s", None)], "source string, text string")
    got = L.checked(claims, sources, "source", "quote", "text")
    assert {r.law: r.verified for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
