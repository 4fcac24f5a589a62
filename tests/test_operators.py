import itertools
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark import plans, sources, streaming
from panelspark.functions import keys as K
from panelspark.functions import textops as X
from panelspark.operators import alignment as A
from panelspark.operators import joins as J
from panelspark.operators import spatial as G
from panelspark.operators import stats as S
from panelspark.operators import survival as V
from panelspark.operators import windows as R
from panelspark.queries import catalogue


def applied(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").withColumn("out", column(F.col("x")))
    return [r.out for r in df.orderBy("i").collect()]


def test_dates_and_keys(spark):
    assert applied(spark, K.iso_date, ["1999-02-03", "March 5, 2004", "7/4/98", "7/4/05", "12/31/2010", "2001-02-30", "soon", "", None]) == ["1999-02-03", "2004-03-05", "1998-07-04", "2005-07-04", "2010-12-31", "", "", "", ""]
    assert applied(spark, lambda x: K.pad_key(x, 3), ["9", "009", "20a", "1234", "x", None]) == ["009", "009", "020A", "1234", "", ""]
    assert applied(spark, K.lot_list, ["9, 20A and O12", "1/2;003", "none"]) == [["9", "20A", "12"], ["1", "2", "3"], []]
    assert applied(spark, K.case_stem, ["2015-004568 cua", "98.123e", "n/a"]) == ["2015-4568", "98-123", ""]
    assert applied(spark, K.surname, ["Commissioner Jane Doe (M)", "Dr. A. B. Smith, Jr."]) == ["doe", "smith"]
    assert applied(spark, K.instrument_number, ["Motion No. 18123", "none", None]) == [18123, 0, 0]
    twice = lambda x: K.pad_key(K.pad_key(x, 4), 4)
    assert applied(spark, twice, ["7b"]) == ["0007B"]


def test_text_measures(spark):
    assert applied(spark, X.mask, ["Within 30 days, two copies."]) == ["within # days # copies"]
    assert applied(spark, X.durations, ["three (3) years or 6 months", "none"]) == [[36.0, 6.0], []]
    assert applied(spark, X.quantities, ["1,200 square feet and 10% of $5,000"]) == [["1200 sqft", "10pct", "$5000"]]
    assert applied(spark, X.citations, ["Section 303(c) and Sections 207.1, Section 303(c)"]) == [["303(c)", "207.1"]]
    df = spark.createDataFrame([("from 6 a.m. to 2 a.m.",)], "x string")
    assert tuple(df.select(*X.hours(F.col("x"))).first()) == (6.0, 26.0)


def test_cascade_labels_and_ambiguity(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, stem string")
    exact = spark.createDataFrame([(1, 10)], "id int, hit int")
    stems = J.unique_key(spark.createDataFrame([("b", 20), ("b", 20), ("c", 30), ("c", 31)], "stem string, hit int"), ["stem"], "hit")
    got = {r.id: (r.hit, r.how) for r in J.cascade_join(left, [("exact", exact, ["id"]), ("stem", stems, ["stem"])], "hit").collect()}
    assert got == {1: (10, "exact"), 2: (20, "stem"), 3: (None, "none"), 4: (None, "none")}


def test_chase_stops_at_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4)], "n int, t int")
    assert {r.n: (r.end, r.hops) for r in J.chase(df, "n", "t").collect()} == {1: (3, 2), 2: (1, 2), 3: (2, 2), 4: (4, 0), 5: (4, 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans(), st.booleans()), min_size=1, max_size=30))
def test_kaplan_meier_and_incidence(spark, rows):
    df = spark.createDataFrame([("k", t, e, e and a) for t, e, a in rows], "k string, t int, e boolean, a boolean")
    curve = {r.t: r.survival for r in V.kaplan_meier(df, ["k"], "t", F.col("e")).collect()}
    s = 1.0
    for t in sorted({t for t, *_ in rows}):
        s *= 1 - sum(e for u, e, _ in rows if u == t) / sum(u >= t for u, *_ in rows)
        assert curve[t] == pytest.approx(s, abs=1e-12)
    one = V.incidence(df, ["k"], "t", F.col("e"), F.lit(False)).collect()
    assert all(r.cif == pytest.approx(1 - curve[r.t], abs=1e-12) for r in one)


def test_weights_keep_their_sum(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(bool(a), int(b)) for a, b in zip(r.random(200) < 0.3, r.integers(0, 9, 200), strict=True)], "t boolean, cell int")
    w = S.reweight(df, "t", ["cell"]).groupBy("t").agg(F.sum("weight").alias("w")).collect()
    assert len({round(x.w, 9) for x in w}) == 1


def test_weighted_quantile_is_a_step(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 10.0, 5)], "k string, x double, w int")
    assert S.weighted_quantile(df, ["k"], "x", "w", 0.5, "m").first().m == 10.0


def test_windows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "i int, v string")
    assert [r.run for r in df.withColumn("run", R.island([], ["i"], F.col("v"))).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    items = spark.sql("select from_json('[{\"pos\":0,\"tag\":\"x\"},{\"pos\":10,\"tag\":\"x\"},{\"pos\":3005,\"tag\":\"x\"},{\"pos\":3006,\"tag\":\"y\"}]', 'array<struct<pos:int,tag:string>>') as a")
    assert [x.pos for x in items.select(R.thinned(F.col("a"), 3000).alias("t")).first().t] == [0, 3005, 3006]


def test_polygons_and_nearest(spark):
    ring = G.parse_ring(F.lit("POLYGON((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))"))
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 1.0), (5.0, 1.0)], "x double, y double")
    assert [r.i for r in df.select(G.inside(F.col("x"), F.col("y"), ring).alias("i")).collect()] == [True, False, True, False]
    assert spark.range(1).select(G.ring_area(ring).alias("a")).first().a == 10.0
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "lid int, lx double, ly double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, 5.0, 0.0), (9, 100.0, 50.0)], "rid int, rx double, ry double")
    assert {r.lid: (r.rid, r.dist) for r in G.nearest(a, b, 1.0).collect()} == {1: (7, 5.0), 2: (9, 50.0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=4), max_size=6))
def test_longest_chain_against_all_choices(candidates):
    got = A.longest_chain(candidates)
    placed = [x for x in got if x is not None]
    assert placed == sorted(set(placed)) and all(x is None or x in c for x, c in zip(got, candidates, strict=True))
    best = max(len(p) for k in itertools.product(*[[None, *c] for c in candidates]) for p in [[x for x in k if x is not None]] if p == sorted(set(p)))
    assert len(placed) == best


def test_greedy_match_and_diff(spark):
    a = spark.createDataFrame([(1, "x", 0.0), (1, "x", 10.0), (2, "x", 0.0)], "doc long, tag string, pos double")
    b = spark.createDataFrame([(1, "x", 9.0), (1, "y", 0.0)], "doc long, tag string, pos double")
    assert [(r.left_pos, r.right_pos) for r in A.greedy_match(a, b, 4.0).collect()] == [(10.0, 9.0)]
    pairs = spark.createDataFrame([(1, ["same", "old heading", "gone"], ["same", "old headings", "brand new"])], "key long, old array<string>, new array<string>")
    assert tuple(A.fuzzy_diff(pairs).first()) == (1, 1, 1, 1, 1)


def test_blocks_are_folded_and_placed_in_passes(spark):
    text = "İn the  first “part” of it.\nThe second part stands here. A third one comes. And the fourth is last."
    blocks = ["in the first 'part' of it", "A third\none comes.", "And the FOURTH is last.", "The second part\tstands here", "is not there", "", None]
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    got = A.align_blocks(docs, spark.createDataFrame([(1, i, b) for i, b in enumerate(blocks)], "doc long, ordinal int, block string")).collect()
    assert [r.offset for r in sorted(got, key=lambda r: r.ordinal)] == [0, text.index("A third"), text.index("And"), text.index("The second"), None, None, None]


def test_blocks_are_placed_however_often_they_stand_and_however_they_are_moved(spark):
    # 100 times the same line, the block of the end moved to the front; 20 blocks in reverse order, of which a pass places one.
    line, words = "the same line. ", [f"word{i}x" for i in range(20)]
    docs = [(1, line * 100 + "The end."), (2, line * 100 + "The end."), (3, " ".join(words))]
    blocks = [(1, i, line) for i in range(100)] + [(1, 100, "the end")] + [(2, 0, "the end")] + [(2, i + 1, line) for i in range(100)] + [(3, i, w) for i, w in enumerate(reversed(words))]
    placed = A.align_blocks(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(blocks, "doc long, ordinal int, block string")).orderBy("doc", "ordinal").collect()
    got = {d: [r.offset for r in placed if r.doc == d] for d in (1, 2, 3)}
    ends, at = [len(line) * i for i in range(100)], len(line) * 100
    assert got == {1: [*ends, at], 2: [at, *ends], 3: [docs[2][1].index(w) for w in reversed(words)]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=25), max_size=20), st.integers(1, 40))
def test_chains_found_anew_are_those_kept_whole(candidates, held):
    whole = A.longest_chain(candidates)
    assert A.longest_chain(candidates, held) == whole
    # By one offset after the other.
    tails, ends, parents = [], [], []
    for block, offsets in enumerate(candidates):
        for offset in sorted(set(offsets), reverse=True):
            k = sum(t < offset for t in tails)
            parents.append((block, offset, ends[k - 1] if k else None))
            tails[k : k + 1], ends[k : k + 1] = [offset], [len(parents) - 1]
    want, at = [None] * len(candidates), ends[-1] if ends else None
    while at is not None:
        block, want[block], at = parents[at]
    assert whole == want


def test_alignment_query_cuts_whole_documents(spark, tmp_path):
    rows = [(1, "".join(f"word{i} " for i in range(200)), "en"), (2, "a short one", "en"), (3, None, "en"), (4, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.lang, r.ordinal): (r.n, r.placed) for r in catalogue.queries()["block_alignment"](spark, str(tmp_path)).collect()}
    assert got == {("en", i): (1 + (i == 0), 1 + (i == 0)) for i in range(-(-len(rows[0][1]) // 60))}


def test_diff_of_whole_texts_and_headings(spark):
    same, ends = "the sponsor shall plant trees along the street " * 8, ["and water them daily in summer " * 12, "but nothing of kind will befall x y z q j k " * 9]
    # Alike up to the end; alike but for numbers; alike in the opening only.
    old, new = [same + ends[0], "within 3 days of " + same, "opening words of the text are the same " + ends[0]], [same + ends[0] + "end", "within 45 days of " + same, "opening words of the text are the same " + ends[1] * 2]
    plain = spark.createDataFrame([(1, old, new)], "key long, old array<string>, new array<string>")
    assert tuple(A.fuzzy_diff(plain).first()) == (1, 0, 2, 1, 1)
    heads = spark.createDataFrame([(1, [ends[0], same, None], [same + "x", ends[1]], ["Tree Extension", "", ""], ["", "Tree Extenslon"])], "key long, old array<string>, new array<string>, old_heads array<string>, new_heads array<string>")
    assert tuple(A.fuzzy_diff(heads).first()) == (1, 0, 1, 1, 1)  # too few headings
    heads = spark.createDataFrame([(1, [ends[0], same], [same + "x", ends[1]], ["Tree Extension", "Care"], ["Noise", "Tree Extenslon"])], "key long, old array<string>, new array<string>, old_heads array<string>, new_heads array<string>")
    assert tuple(A.fuzzy_diff(heads).first()) == (1, 0, 2, 0, 0)


def test_diff_query_reads_whole_turns(spark, tmp_path):
    opening = "the same first forty characters of all of it, "
    rows = [(1, 0, "user", opening + "apples " * 30), (1, 1, "assistant", "zzz " * 40), (1, 2, "user", opening + "qkjx wvb " * 60), (1, 3, "assistant", "zzz " * 40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert tuple(catalogue.queries()["fuzzy_diff"](spark, str(tmp_path)).first()) == (1, 1, 0, 1, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": \n{"x": 2}\n')
    good, broken = sources.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x int")
    assert sorted(r.x for r in good.collect()) == [1, 2] and broken.count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.csv", "a,b\n1,2\n")
    assert [(r.a, r.b) for r in sources.read_zip_csv(spark, str(tmp_path / "z.zip"), "a string, b string").collect()] == [("1", "2")]
    (tmp_path / "t.csv").write_text("a,b\n007,\n")
    assert tuple(sources.read_text_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).first()) == ("007", None)
    page = spark.createDataFrame([("<p>a<script>x</script> b</p><a href=\"/q\">c</a>",)], "h string")
    assert sources.html_text(page, "h", "t").first().t == "a\nb\nc" and page.select(sources.links(F.col("h")).alias("l")).first().l == ["/q"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 5)], "k int, v string, w int")
    assert {(r.k, r.v, r.w) for r in sources.upsert(old, new, ["k"]).collect()} == {(1, "a", None), (2, "c", 5)}


def test_stream_totals(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = streaming.windowed_totals(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from totals").first().s == events.count()


def test_scans_are_pruned(spark):
    from panelspark.queries import linkage

    df = linkage.semi_anti_counts(spark, "/root/testdata/sf0.001")
    assert plans.read_columns(df) <= {"c_custkey", "c_mktsegment", "o_custkey", "o_totalprice"}
