import itertools
from zlib import crc32

import numpy as np
import pytest

from panelspark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def slow_kernel(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.LENGTH):
        for b in itertools.combinations(range(len(t)), toxicity.LENGTH):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_all_subsequences():
    words, marks = ["idiot", "idxiot", "abc", "a", "mmmm", "toidi"], ["idiot", "abcabc", "mm", "tt"]
    got = toxicity._subsequences(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(slow_kernel(w, m))


def test_table_and_features_are_the_kernel():
    marks, words = ["^idiot$", "^banana$", "^ﬀé$"], ["^idixot$", "^bandana$", "^zzzz$", "^éﬀ$", "^the$"]
    norm = lambda s, t: slow_kernel(s, t) / (slow_kernel(s, s) * slow_kernel(t, t)) ** 0.5
    want = np.array([[norm(w, m) for m in marks] for w in words])
    assert toxicity.Features(marks).kernel(words) == pytest.approx(want, abs=1e-5)
    model = toxicity.Model(landmarks=marks, weights=np.array([1.0, -2.0, 0.5]), bias=-0.3).collapse()
    assert model.margins([*words, "ab"]) == pytest.approx([*(want @ model.weights - 0.3), -0.3])


@pytest.fixture(scope="module")
def small(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.train(docs, labels)


def test_insults_gaps_and_inserted_characters(small):
    clean = "the nation and the reading of things that are in the order of stations"
    p = lambda t: small.probabilities([t])[0]
    assert p(clean) < 0.3 and p("") < 0.3
    for word in ("idiot", "idioot", "idxiot", "i-d-i-o-t", "IDIOT!", "1d10t", "w o r t h l e s s", "patheetic", "mo-ron", "disgustinng", "x" * 40 + "idiot" + "y" * 40):
        assert p(f"{clean} {word} {clean}") >= 0.3, word


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = queries.op4_toxicity(spark, SF).collect()
    assert {r.doc_id for r in got} == docs and len(got) == len(docs)
    found = {0: [], 1: []}
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if r.held_out and r.doc_id in labels:
            found[labels[r.doc_id]].append(r.predicted)
    assert np.mean(found[1]) > 0.88 and np.mean(found[0]) < 0.02


def test_learning_does_not_look_at_held_out_rows(spark):
    own = lambda i: "".join(chr(97 + int(c)) * 2 for c in str(i))
    docs = spark.createDataFrame([(i, "plain words here") for i in range(40)] + [(100 + i, f"{own(i)} zzyzx {own(9 * i)}") for i in range(40)], "doc_id long, text string")
    marks = [(i, int(i >= 100)) for i in [*range(40), *range(100, 140)]]
    held = [m for m in marks if crc32(str(m[0]).encode()) % 4 == 2]
    model = toxicity.train(docs, spark.createDataFrame(held, "doc_id long, toxic int"))
    assert model.table is None
    assert toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).table is not None


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "idiot", 5), (1, None, 5), (3, "w" * 50_000, 5)], "doc_id long, text string, score int")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, model)
    assert got.count() == 5 and got.where("score is null or score >= 0.3").count() == 0
    one = toxicity.train(docs, spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, one).count() == 5 and toxicity.score(docs.limit(0), one).count() == 0
    said = [(1.0, ["b", "idiot", f"w{i}x"]) for i in range(6)]
    assert toxicity.learn([("idiot", 6, 6, 0), ("wordy", 1, 1, 6)], 6, 6, said, [(1.0, ["wordy", "here"])]).margins(["^idiot$"])[0] > 0


def test_long_words_and_texts(small):
    assert small.probabilities(["word " * 200_000, "x" * 100_000]).shape == (2,)
    assert small.probabilities([" ".join("the idiot".split() * 3)])[0] >= 0.3
