"""Queries over whole tables against plain Python."""

import re
import statistics
from collections import Counter, defaultdict

import pytest

from panelspark.functions.textops import NUMBER_WORDS
from panelspark.queries import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("orders", "lineitem")}


def test_two_hop_bridge_of_every_customer(spark, tables):
    suppliers, same_day = defaultdict(set), defaultdict(list)
    for r in tables["lineitem"]:
        suppliers[r.l_orderkey].add(r.l_suppkey)
    day = lambda r: (r.o_custkey, str(r.o_orderdate)[:10])
    for r in tables["orders"]:
        same_day[day(r)].append(r.o_orderkey)
    want = {}
    for r in tables["orders"]:
        found = set().union(*(suppliers[k] for k in same_day[day(r)])) if r.o_orderpriority == "1-URGENT" else set()
        if found:
            want[r.o_orderkey] = (len(found), min(found))
    assert {r.o_orderkey: (r.n_suppliers, r.first_supplier) for r in catalogue.queries()["two_hop_bridge"](spark, SF).collect()} == want


def test_linkage_rule_scores_of_every_customer(spark, tables):
    customer = {r.o_orderkey: r.o_custkey for r in tables["orders"]}
    cases = defaultdict(lambda: [0, 0, 0])
    for r in tables["lineitem"]:
        if r.l_orderkey in customer:
            true, picked = r.l_discount >= 0.08, r.l_quantity >= 35
            for i, x in enumerate((true and picked, true, picked)):
                cases[customer[r.l_orderkey]][i] += x
    cases = [c for c in cases.values() if c[1]]
    want = (statistics.mean(b / p for b, _, p in cases if p), statistics.mean(b / t for b, t, _ in cases), statistics.mean(p > 0 for *_, p in cases), statistics.median(p for *_, p in cases))
    got = catalogue.queries()["linkage_rule_scores"](spark, SF).first()
    assert tuple(map(float, got)) == pytest.approx(want)


def test_template_frequency_by_200_characters(spark):
    mask = lambda t: re.sub(r"[^a-z#]+", " ", re.sub(rf"[0-9][0-9,.]*|\b(?:{'|'.join(NUMBER_WORDS)})\b", "#", t.lower(), flags=re.A)).strip()
    keys = [(mask(r.text or "")[:200], r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = Counter(k for k, _ in keys if k)
    want = [(k, c, min(i for x, i in keys if x == k)) for k, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:10]]
    assert [tuple(r) for r in catalogue.queries()["template_frequency"](spark, SF).collect()] == want
