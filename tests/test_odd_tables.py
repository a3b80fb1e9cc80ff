"""Queries against their SQL twins on small tables that hold what the given ones rarely do."""

import duckdb

from factweave.plans import catalogue


def same_as_twin(spark, folder, name, **tables):
    connection = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    own = catalogue.QUERIES[name](spark, str(folder))
    expected = connection.execute(f"SELECT {', '.join(own.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    got = [tuple(r) for r in own.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return got


def test_prices_halfway_between_two_addresses(spark, tmp_path):
    orders = [(k, k / 2) for k in range(180, 260)]
    got = same_as_twin(spark, tmp_path, "address_ranges", part=([(1, 3), (0, 100)], "p_partkey long, p_size int"), orders=(orders, "o_orderkey long, o_totalprice double"))
    assert (201, 1) in got and (205, 1) in got and (199, 1) in got


PAGES = ([(1, "http://h/x", '<a href="/a">1</a><a href="/b">2</a>'), (2, "http://h/x", '<a href="/c">3</a><a href="/a">1</a>'), (3, "http://h/y", '<a href="/c">3</a>'), (4, "http://h/x", None)], "page_id long, url string, html string")


def test_links_of_pages_saved_twice(spark, tmp_path):
    got = same_as_twin(spark, tmp_path, "page_links", pages=PAGES)
    assert sorted(link[-1] for url, link in got if url.endswith("x")) == ["a", "b", "c"]


def test_degrees_over_pages_saved_twice(spark, tmp_path):
    assert sorted(same_as_twin(spark, tmp_path, "link_graph_degree", pages=PAGES)) == [("http://h/a", 1), ("http://h/b", 1), ("http://h/c", 2)]
