"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from evspark.llm import queries as Q

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    rel = con.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted((tuple(r) for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert {d[0]: str(d[1]) for d in rel.description} == {c: {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER"}[k] for c, k in df.dtypes}
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_all_are_registered():
    import __spark_entry__

    assert sorted(n.split("_")[0] for n in Q.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert {*Q.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
