"""The filter audit against plain Python; the query itself is compared with SQL in test_sql."""

import re
from collections import Counter
from itertools import permutations

import pytest

from panelspark.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string, mask int", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good, toxic = ({d for d, *kind in labels if kind[i] == 1} for i in (0, 1))
    masks = []
    for id_, text, part, _ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        upper = sum("A" <= c <= "Z" for c in text)
        again = id_ is not None and any(d is not None and d < id_ and (t or "") == text for d, t, *_ in docs)
        mask = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), again), strict=True) if bad}
        masks.append((part or "", mask, id_ in good, id_ in toxic))
    out, shapley = [], Counter()
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                here = [m for m in mine if f in m[1] and not m[1] & set(order[: step - 1])]
                shapley[part, f] += len(here)
                out.append([part, "".join(order), step, sum(not m[1] & set(order[:step]) for m in mine), len(here), sum(f in m[1] for m in mine) - len(here), sum(m[1] == {f} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (5, LONG, "a", 1), (3, LONG, "b", 1), (9, LONG, None, 1), (9, LONG, "a", 1), (3, LONG, "b", 1), (1, "Short", "a", 1), (2, None, "", 1), (4, "", "b", 1), (None, LONG, "a", 1), (None, LONG, "a", 1),
    (7, "same " * 300, "a", 1), (7, "SAME " * 300, "b", 1), (11, LONG + " $", "b", 1), (12, LONG.upper(), "b", 1), (13, "x\x1cy z\x85 " * 120, "b", 1), (14, LONG, "b", 1),
]
KNOWN = [(5, 1, 1), (5, 0, 0), (9, 1, None), (7, None, 1), (None, 1, 1), (14, 0, 1), (1, 1, 0)]


@pytest.mark.parametrize("hashed", [filter_audit.fingerprint, lambda raw: 0, lambda raw: len(raw) % 3])
@pytest.mark.parametrize("chunk", [1, 3_000, 10**6])
@pytest.mark.parametrize("parts", [1, 5])
def test_collisions_chunks_and_parts(spark, hashed, chunk, parts):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(parts)
    got = filter_audit.audit(docs, spark.createDataFrame(KNOWN, LABELS), hashed=hashed, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == plain(ROWS, KNOWN)


def test_copies_in_one_chunk_send_one_text(spark):
    sent = list(filter_audit._sent([(i, LONG, "a") for i in range(1000)], filter_audit.fingerprint, 10**6))
    assert sum(value[0] is not None for _, value in sent) == 1 and len(sent) == 1000


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audit(spark.createDataFrame(ROWS[:1], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert sorted(map(tuple, one)) == plain(ROWS[:1], [])
