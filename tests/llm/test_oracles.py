"""Queries with SQL twins against them on the smallest tables."""

import duckdb
import pytest

from factweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    own = queries.QUERIES[name](spark, FOLDER)
    assert sorted(map(tuple, own.collect())) == sorted(connection.execute(queries.ORACLE[name]).fetchall())
