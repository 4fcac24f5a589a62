import gzip
import json
import zipfile

import pytest

from panelspark import sources as S
from panelspark.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_items_gz_documents_and_wanted_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "meeting_date": "2001-02-03", "year": "1999"}\n{"id": 2, "meeting_date": "soon", "year": "1999"}\n{broken\n')
    items, broken = S.read_items(spark, str(tmp_path / "a.jsonl"), "id int, meeting_date string, year string")
    assert [(r.id, str(r.meeting_date), r.year) for r in items.orderBy("id").collect()] == [(1, "2001-02-03", 2001), (2, "None", 1999)]
    assert [r.line for r in broken.collect()] == ["{broken"]
    (tmp_path / "d").mkdir()
    whole = gzip.compress(json.dumps({"k": "x"}).encode())
    for name, data in (("good", whole), ("cut", whole[:-9]), ("no", gzip.compress(b"[nothing"))):
        (tmp_path / "d" / f"{name}.json.gz").write_bytes(data)
    docs, bad = S.read_documents_gz(spark, str(tmp_path / "d"), "k string")
    assert [r.k for r in docs.collect()] == ["x"] and sorted(r.error for r in bad.collect()) == ["EOFError", "not JSON"]
    (tmp_path / "big.csv").write_text("a,b,c\n1,x,p\n2,y,q\n2,z,r\n")
    keys = spark.createDataFrame([("2",), ("2",), ("9",)], "a string")
    assert rows(S.read_wanted(spark, str(tmp_path / "big.csv"), keys, ["a"], ["b"])) == [("y",), ("z",)]


def test_zip_members_kinds_and_pools(spark, tmp_path):
    for agency in "ab":
        with zipfile.ZipFile(tmp_path / f"{agency}.zip", "w") as z:
            z.writestr("stops.csv", f"stop_id,lat\n{agency}1,1.5\n")
    stops = {a: S.read_zip_csv(spark, str(tmp_path / f"{a}.zip"), "stop_id string, lat string").drop("archive") for a in "ab"}
    assert rows(S.pooled(stops, "agency")) == [("a1", "1.5", "a"), ("b1", "1.5", "b")]
    files = spark.createDataFrame([(1, bytearray(b"%PDF-1.4")), (2, bytearray(b"  <!DOCTYPE html>")), (3, bytearray(b"PK\x03\x04")), (4, bytearray(b"plain"))], "i int, content binary")
    assert [r.k for r in files.select("i", S.content_kind(S.F.col("content")).alias("k")).orderBy("i").collect()] == ["pdf", "html", "zip", "text"]


def test_upsert_is_settled_by_the_rows(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "z"), (2, "c"), (3, "d")], "k int, v string")
    assert rows(S.upsert(old, new, ["k"])) == [(1, "a", 0), (2, "c", None), (3, "d", None)]


def test_tables_are_put_in_place_whole_and_skipped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sinks.write_table(spark.range(3), source)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS x")

    assert [sinks.built(spark, [source], out, make)[1] for _ in range(2)] == [True, False] and len(made) == 1
    assert rows(spark.read.parquet(out)) == [(0,), (2,), (4,)] and not (tmp_path / "out.part").exists()
    with pytest.raises(FileNotFoundError):
        sinks.built(spark, [str(tmp_path / "none")], out, make)
    sinks.write_csv(spark.createDataFrame([(1, "x,y")], "a int, b string"), str(tmp_path / "c"))
    assert rows(S.read_text_csv(spark, str(tmp_path / "c"))) == [("1", "x,y")]


def test_flat_records_stages_and_metrics(spark):
    df = spark.createDataFrame([(1, (["a", "b"], [("n", "s")], "3-2"))], "id int, extracted struct<ayes:array<string>,speakers:array<struct<name:string,stance:string>>,tally:string>")
    flat = sinks.flattened(df, "extracted", derive={"vote": S.F.concat(S.F.lit("ayes "), S.F.col("ayes"))}, order=["vote", "id"])
    assert flat.columns[:2] == ["vote", "id"] and flat.first().asDict() == {"vote": "ayes a; b", "id": 1, "ayes": "a; b", "speakers": '[{"name":"n","stance":"s"}]', "tally": "3-2"}
    told = sinks.run_stages([("one", lambda: None), ("two", lambda: 1 / 0), ("three", lambda: None)])
    assert [(t["stage"], t["status"]) for t in told] == [("one", "ok"), ("two", "failed"), ("three", "ok")] and "ZeroDivision" in told[1]["error"]
    a, b = spark.createDataFrame([(1, 2.5)], "n int, mean double"), spark.createDataFrame([(7,)], "m int")
    assert rows(sinks.metrics({"a": a, "b": b})) == [("m", "7"), ("mean", "2.5"), ("n", "1")]
    with pytest.raises(ValueError):
        sinks.metrics({"a": a, "c": a})
