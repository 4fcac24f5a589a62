"""Every query with SQL against DuckDB over the smallest tables; the rest must run."""

import math

import duckdb
import pytest

from panelspark.queries import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)) and type(v).__name__ != "Decimal":
        return str(v)
    return f"{float(v):.6g}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalogue.oracle_sql():
        result = duck.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert got == rows(names, result.fetchall())
