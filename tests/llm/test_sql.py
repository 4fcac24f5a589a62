"""Queries of training-data operators with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

from panelspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "clicks", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    want = sorted(tuple(str(r[n]) for n in names) for r in want.to_arrow_table().to_pylist())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == want
