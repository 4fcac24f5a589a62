"""What grows no faster than the input: expressions that say a thing once, frames that are read once, points that meet few others."""

from pyspark.sql import functions as F

from panelspark.queries import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_of_blocks_reads_no_frame_anew_for_every_row(spark):
    shown = plan(catalogue.queries()["dates_of_blocks"](spark, "/root/testdata/sf0.001"))
    assert "currentrow$(), unboundedfollowing$()" not in shown


def test_durations_cut_a_text_into_tokens_once(spark):
    from panelspark.functions import textops as X

    df = spark.createDataFrame([("for three (3) years, or twenty-four months, or 36 months; no months",)], "t string").select(X.durations(F.col("t")).alias("d"))
    assert df.first().d == [36.0, 24.0, 36.0]
    assert plan(df).count("regexp_extract_all") == 1


def test_landmarks_walk_no_steps_for_a_draw(spark):
    from panelspark.operators import landmarks as L

    rows = [(i, i < 1000, "2024-01-01", f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}" if i < 1000 else None, None, None, "a" if i % 7 else "b") for i in range(1500)]
    units = spark.createDataFrame(rows, "id long, treated boolean, start string, event string, done string, left string, cell string").select("id", "treated", *[F.to_date(c).alias(c) for c in ("start", "event", "done", "left")], "cell")
    placed = L.landmarks(units, ["cell"], (1, 2), lambda i, s: i * s)
    assert "filter(" not in plan(placed)
    lags = {c: sorted((r.event - r.start).days for r in units.where(f"treated and cell = '{c}'").collect()) for c in "ab"}
    for r in placed.where("not treated").collect():
        assert (r.landmark - r.start).days == lags[r.cell][r.id * r.seed % len(lags[r.cell])]


def test_nearest_rings_shrink_with_the_distance_between_points(spark):
    from panelspark.operators import spatial as G

    right = spark.range(4000).select(F.col("id").alias("rid"), (F.col("id") % 40 / 4).alias("rx"), (F.col("id") / 40).cast("int").alias("ry"))
    assert G.cell_size(right, "rx", "ry", 64.0, 4, 16) <= 2.0
    left = right.where("rid % 7 = 0").select(F.col("rid").alias("lid"), (F.col("rx") + 0.1).alias("lx"), F.col("ry").alias("ly"))
    got = G.nearest(left, right, 64.0).collect()
    assert len(got) == 572 and all(r.lid == r.rid and abs(r.dist - 0.1) < 1e-9 for r in got)


def test_stems_of_keys_of_seven_digits(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1234567, 5, "Brand#12"), (999999, 7, "Brand#3")], "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalogue.queries()["norm_keys"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.oracle_sql()["norm_keys"]).fetchall())
    assert got[1][3] == "2007-1234567"


def test_counts_within_a_radius_as_by_all_pairs(spark):
    from panelspark.operators import spatial as G

    # Many points of few positions, some exactly at the radius, some far away.
    left = spark.range(300).select(F.col("id").alias("lid"), (F.col("id") * 37 % 101 / 10).alias("lx"), (F.col("id") * 53 % 97 / 10).alias("ly"))
    left = left.unionByName(spark.createDataFrame([(900, 500.0, 0.0)], left.schema))
    right = spark.range(6000).select(F.col("id").alias("rid"), (F.col("id") * 29 % 103 / 10).alias("rx"), (F.col("id") * 71 % 89 / 10).alias("ry"))
    dist = F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)
    want = left.crossJoin(right).where(dist <= 3.0).groupBy("lid").agg(F.count("*").alias("n"), F.min(dist).alias("least"))
    assert sorted(map(tuple, G.counted_within(left, right, 3.0).collect())) == sorted(map(tuple, want.collect()))


def test_spatial_joins_broadcast_nothing(spark):
    from panelspark.operators import spatial as G

    # Small enough that each join would be a broadcast; the last points are left to a second ring.
    left = spark.range(50).select(F.col("id").alias("lid"), (F.col("id") / 8).alias("lx"), (F.col("id") % 7 + 0.5).alias("ly"))
    right = spark.range(60).select(F.col("id").alias("rid"), (F.col("id") / 10).alias("rx"), (F.col("id") % 11).cast("double").alias("ry"))
    for df in (G.counted_within(left, right, 3.0), G.nearest(left, right, 1.0)):
        assert df.count() > 0 and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_header_fields_search_for_a_label_once(spark):
    from panelspark.functions import headers as H

    df = spark.range(1).select(H.fields(F.concat(F.lit("x"), "id"), F.lit("May 1, 1999")).alias("h"))
    assert plan(df).count("called to order by (?:acting )?(?:vice") <= 2


def test_measures_read_a_number_once(spark):
    from panelspark.functions import parsing as P

    df = spark.range(1).select(P.numbers_of(F.concat(F.lit("Parking"), "id"), F.concat(F.lit("no more than 12 parking "), "id")).alias("m"))
    assert df.first().m.parking_max == 12.0 and plan(df).count("no more than") <= 2


def test_block_fields_cut_a_block_at_its_action_once(spark):
    from panelspark.functions import itemfields as I

    df = spark.range(1).select(I.fields(F.concat(F.lit("ACTION: approved "), "id")).alias("f"))
    assert df.first().f.action == "approved"
    # Before, the label stood so often that the plan's text was cut before it.
    assert df._jdf.queryExecution().analyzed().toString().count("(?:ACTION)") == 1


def test_alignment_makes_no_frame_for_each_document(spark):
    from panelspark.operators import alignment as A

    docs = spark.createDataFrame([(1, "Alpha beta. Gamma delta 7."), (2, None), (3, "unused")], "doc long, text string")
    blocks = spark.createDataFrame([(1, 1, "gamma DELTA 7."), (1, 0, "Alpha beta."), (2, 0, "x"), (4, 0, "alpha"), (None, 0, "alpha")], "doc long, ordinal int, block string")
    placed = A.align_blocks(docs, blocks)
    assert sorted(map(str, map(tuple, placed.collect()))) == sorted(map(str, [(1, 0, 0), (1, 1, 12), (2, 0, None), (4, 0, None), (None, 0, None)]))
    assert "CoGroup" not in plan(placed)


def test_blocks_of_documents_are_cut_by_characters(spark, tmp_path):
    text = "a\n" + "\U0001f600é" * 70
    spark.createDataFrame([(1, text, "en"), (2, "", "en"), (3, "x" * 60, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ordinal: r.n for r in catalogue.queries()["block_alignment"](spark, str(tmp_path)).collect()}
    assert got == {0: 2, 1: 1, 2: 1}


def test_fuzzy_diff_deals_its_rows_over_tasks(spark):
    from panelspark.operators import alignment as A

    pairs = spark.createDataFrame([(i, ["one cat", "b 1", "same"], ["same", "b 2", "b 3"]) for i in range(64)], "key long, old array<string>, new array<string>").coalesce(1)
    told = A.fuzzy_diff(pairs, 0.5)
    assert {tuple(r)[1:] for r in told.collect()} == {(1, 1, 1, 1)}
    assert told.rdd.getNumPartitions() > 8


def test_candidate_places_are_counted_where_their_stems_lie(spark, tmp_path):
    import duckdb

    orders = [("2001-02-03", c, p) for c in (1, 1, 2, 17) for p in ("1-LOW", "1-low", "2-HIGH", "2-HIGH")] + [("2001-05-05", 3, "5-X"), ("2002-01-01", 1, "1-LOW"), ("2002-01-01", 123456789, "4-")]
    lines = [(101, "R", "1999-01-01"), (101, "A", "2001-01-01"), (101, "A", "2001-06-01"), (12, "R", "2001-01-01"), (999999, "N", "1998-01-01"), (1000000, "R", "1998-01-01")]
    spark.createDataFrame([(i, *o) for i, o in enumerate(orders)], "o_orderkey long, d string, o_custkey long, o_orderpriority string").selectExpr("*", "cast(d as timestamp) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string, d string").selectExpr("*", "cast(d as timestamp) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.queries()["candidate_places"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalogue.oracle_sql()["candidate_places"]).fetchall())
    # Neither rows for each distinct count nor one deal for each step.
    assert "Expand" not in plan(df) and df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") <= 7


def test_records_of_plain_texts_are_told_where_they_stand(spark):
    from panelspark.operators import conditions as C

    exhibit = "\n".join(["Exhibit  A", "1. A.", "2. B.", "3. C."])
    docs = [
        (1, f"Draft Motion\nMotion No. 100\n{exhibit}"), (2, f"x\n{exhibit}"), (3, " \t\r\n12\r\nPage 3 of 4\n a \t b\x0b\n\nc\f\nd"), (4, "Record  No.\t2010.0044x\nCase No. 2011.0001\nwas adopted on May 5,  2010"), (5, "case no.\n2010.0044x adopted\nMay 5, 2010"),
        (6, "head 1\na\fhead 2\nb\fhead 3\nc"), (7, "12"), (8, "\n \r\n"), (9, None), (10, "FILE # 2010.0044X"), (11, "a draft\xa0motion of x"), (12, "the draft  resolution; conditions of a motion\nno exhibit a"), (None, "x"), (13, "über Case NO 98.1234"), (14, "v\r"),
    ]
    df = spark.createDataFrame(docs, "doc long, text string")
    got = C.records_of(df, "doc", "text")
    want = C.records(C.lines_of(df, "doc", "text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.dtypes == want.dtypes
    assert {(r.key, r.section): r.n_lines for r in got.collect()} == {(1, 0): 1, (1, 1): 5, **{(k, 0): n for k, n in {2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 10: 1, 11: 1, 12: 2, 13: 1}.items()}}
    # Two texts of one key are one document.
    twice = spark.createDataFrame([(1, "a\nb"), (1, "c\nFile No. 2010.0044"), (2, "d")], "doc long, text string")
    assert {r.key: (r.n_lines, r.key_source) for r in C.records_of(twice, "doc", "text").collect()} == {1: (4, "case"), 2: (1, "document")}
