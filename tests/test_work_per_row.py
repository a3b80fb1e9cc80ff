"""What the given tables are too small to show: how often inputs are read, and over how many tasks they are dealt."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.operators import binary, frontend
from factweave.plans import catalogue, corpora, intake
from factweave.sources import inputs

FOLDER = "/root/testdata/sf0.001"


def test_rows_of_many_bundles_leave_in_one_batch(monkeypatch):
    text = json.dumps({"input_type": "web_backend_sources", "files": [{"source_file": "a.c", "content": "x"}, 5]})
    table = pa.RecordBatch.from_arrays([pa.array([f"b{k}" for k in range(100)] + ["none", "bad"]), pa.array([text] * 100 + [None, "{"])], ["input", "content"])
    whole = list(inputs.bundle_batches(iter([table, table]), "backend"))
    assert [b.num_rows for b in whole] == [404]
    monkeypatch.setattr(inputs, "BATCH_CHARS", 3 * len(text))
    parts = list(inputs.bundle_batches(iter([table, table]), "backend"))
    assert max(b.num_rows for b in parts) <= 8 and [r for b in parts for r in b.to_pylist()] == whole[0].to_pylist()


def test_hints_parse_and_search_pages_once(spark):
    pages = spark.createDataFrame([("a", "<a href='/login'>")], "source_file string, content string")
    for words in (V.AUTH_WORDS, V.STATE_WORDS):
        plan = frontend.hints(pages, words)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_narrow_tables_in_one_file_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows in (corpora.json_bundles(spark, FOLDER), corpora.form_pages(spark, FOLDER), intake.order_lines(spark, FOLDER, "'a'", "'b'")):
        met = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(met) >= cores and max(r["count"] for r in met) < 2 * sum(r["count"] for r in met) / len(met)


def test_contexts_meet_in_one_shuffle_of_keys(spark):
    plan = corpora.contexts(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_summary_reads_contexts_for_all_tables_together(spark):
    plan = binary.summary(corpora.contexts(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 13


def test_summary_writes_a_row_for_each_function_and_string(spark, monkeypatch):
    """Not one for each context, of which thousands are read at once."""
    written, kept = [], binary.stored
    monkeypatch.setattr(binary, "stored", lambda rows: written.append(kept(rows)) or written[-1])
    assert binary.summary(corpora.contexts(spark, FOLDER)).count() == 10
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert [t.count() for t in written] == [items.count(), items.select("l_suppkey", "l_partkey").distinct().count()]


def test_cells_and_totals_of_ranges_do_not_pass_the_driver(spark):
    for name in ("nested_ranges", "address_ranges"):
        rows = catalogue.QUERIES[name](spark, FOLDER)
        assert rows.count() and "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        rows.collect()
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_ends_of_calls_meet_in_one_shuffle(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 2), (0, 1, 3), (0, 2, 2), (1, 1, 1), (0, 5, None)], "doc_id int, caller_addr int, callee_addr int")
    found = binary.call_counts(edges, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r.doc_id, r.addr, r.callers, r.callees) for r in found.where("addr IS NOT NULL").collect()) == [(0, 1, 0, 2), (0, 2, 3, 1), (0, 3, 1, 0), (0, 5, 0, 0), (1, 1, 1, 1)]
