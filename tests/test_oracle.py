"""Every registered query with SQL gives the rows DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from lodestone import queries_parts, queries_plans  # noqa: F401 - register their queries
from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name]).fetch_arrow_table() if hasattr(duck, "fetch_arrow_table") else duck.sql(ORACLE_SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.columns) == sorted(want.column_names)
    columns = sorted(got.columns)
    assert rows(columns, (r.asDict() for r in got.collect())) == rows(columns, want.to_pylist())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_topk_plan(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.knn import knn, vector_of

    corpus = spark.read.parquet(f"{SF}/embeddings.parquet")
    plan = knn(corpus, vector_of(corpus, 0), 10, F.col("label") == 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(label,3)" in plan
    assert "EqualTo(label,3)" in QUERIES["knn_filtered"](spark, SF)._jdf.queryExecution().toString()
