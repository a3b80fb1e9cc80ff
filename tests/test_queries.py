"""Every query of the catalogue against its SQL twin on the smallest tables."""

import duckdb
import pytest

from factweave.plans import catalogue, intake, shapes  # noqa: F401 (intake and shapes add their queries to the catalogue)

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_twin(spark, duck, name):
    own = catalogue.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(own.columns) == sorted(names)
    shown = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    expected = [tuple(shown(r[names.index(c)]) for c in own.columns) for r in cursor.fetchall()]
    got = [tuple(map(shown, r)) for r in own.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_queries_name_their_operators():
    assert set(catalogue.OPERATORS) == set(catalogue.QUERIES) and all(catalogue.OPERATORS.values())
