"""Every query against DuckDB: names, kinds and values of columns, rows in any order."""

import math
import os

import duckdb
import pytest

from evspark.plans import catalogue

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows, order):
    def key(v):
        return (v is None, round(v, 6) if isinstance(v, float) and math.isfinite(v) else v)

    return sorted([tuple(key(r[i]) for i in order) for r in rows], key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = df.collect()
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    names = sorted(columns)
    assert plain(found, [df.columns.index(c) for c in names]) == plain(want, [columns.index(c) for c in names])
