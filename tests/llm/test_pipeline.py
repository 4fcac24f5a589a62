import re
from collections import Counter
from hashlib import sha256

import corpus_pipeline
import test_bpe as bytes_of
import test_mixing as mixes
import test_ngram_join as ngrams
import test_text_operators as texts
from panelspark.llm import mixing, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_their_contracts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            seen[name] = rows
    kept = {r.doc_id for r in seen["toxicity"]}
    insult = re.compile(r"\b(?:idiot|moron|worthless|pathetic|disgusting|scum|clown|trash|stupid|loser)\b", re.I)
    assert not any(insult.search(before[i].text) for i in kept) and len(kept) > 0.8 * len(before)
    assert len(seen["ngram_jaccard"]) == len({r.doc_id for r in seen["ngram_jaccard"]}) < len(kept)
    assert all("@mail" not in r.text and r.n_chars == len(r.text) for r in seen["pii"])
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["pii"]}
    assert docs.count() == len(seen["mixing"])
    assert corpus_pipeline.run(spark, sf).count() == len(seen["mixing"])


def test_stages_on_nulls_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", None, 11), (3, "a b c d e f", "en", None, 11), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, sf)
            part.collect()


def test_rows_of_one_doc_id_are_judged_by_themselves(spark):
    copy, other, third = ("a b c d e f g h", "quite another text of eight words here indeed", "and one more that nobody else has written down")
    rows = [(1, copy, "en", "s", 1), (2, copy, "en", "s", 1), (2, other, "en", "s", 1), (3, third, "en", "s", 1), (3, third, "en", "s", 1), (3, other, "en", "s", 1), (None, copy, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies_out(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted([(1, copy), (2, other), (3, third), (0, copy)])


def test_mix_takes_each_row_as_decided(spark):
    rows = [(i // 4 if i % 3 else None, "w " * (1 + i % 17), "en", f"src{i % 3}", i) for i in range(240)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, lang string, source string, n_chars long")
    taken = corpus_pipeline.mixed(spark, docs, "").collect()
    keyed = docs.withColumn("k", mixing.F.xxhash64(mixing.F.to_json(mixing.F.struct(*docs.columns))))
    words = {r.source: r.n for r in mixing.mix(keyed, key="k").groupBy("source").agg(mixing.F.sum("taken").alias("n")).collect()}
    got = Counter()
    for r in taken:
        got[r.source] += len(r.text.split())
    assert got == {k: v for k, v in words.items() if v}
    assert Counter(map(tuple, corpus_pipeline.mixed(spark, docs.repartition(5), "").collect())) == Counter(map(tuple, taken))


def brute_redaction(text):
    """Every span of plain Python's finding as [KIND], overlapping ones together as the first one's kind."""
    out, at, last = [], 0, 0
    for start, kind, end in sorted(texts.base_spans(text) + texts.added_spans(text)):
        if start < last:
            last = max(last, end)
            at = last
            continue
        out += [text[at:start], f"[{pii.ALL_KINDS[kind].upper()}]"]
        at = last = end
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    score = {i: model.probabilities([r.text or ""])[0] for i, r in before.items()}
    clean = corpus_pipeline.toxic_out(spark, docs, sf)
    kept = {i for i, p in score.items() if p < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == kept
    single = corpus_pipeline.near_copies_out(spark, clean, sf)
    want = {d for d, _, c in ngrams.brute([(i, before[i].text) for i in sorted(kept)]) if d == c}
    assert {r.doc_id for r in single.collect()} == want
    redacted = corpus_pipeline.personal_data_out(spark, single, sf)
    rows = {r.doc_id: r for r in redacted.collect()}
    assert {i: r.text for i, r in rows.items()} == {i: brute_redaction(before[i].text or "") for i in want}
    assert all(r.n_chars == len(r.text) for r in rows.values())
    mixed = corpus_pipeline.mixed(spark, redacted, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    words = Counter()
    for r in rows.values():
        words[r.source] += len(WORD.findall(r.text))
    targets, taken = mixes.shared(words), Counter()
    for i, k in times.items():
        assert 1 <= k <= 3
        taken[rows[i].source] += k * len(WORD.findall(rows[i].text))
    largest = {s: max(len(WORD.findall(r.text)) for r in rows.values() if r.source == s) for s in targets}
    for s, t in targets.items():  # a source of few documents can be off by one of them
        assert abs(taken[s] - t) <= max(50, largest[s]), s
    for r in corpus_pipeline.encoded(spark, mixed, sf).collect():
        ids = bytes_of.THEIRS.encode_ordinary(rows[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == sha256(rows[r.doc_id].text.encode()).hexdigest()
