"""Rules and functions that users add, and fusion of facts that arrive."""

import json

import pytest

from factweave.operators import plugins
from factweave.streaming import fusion


@pytest.fixture
def sources(spark):
    rows = [("a.c", "TODO(ann): x\nint y;\ntodo(bob): z todo(cy): w"), ("b.c", None), ("c.c", "nothing")]
    frame = spark.createDataFrame(rows, "source_file string, content string")
    frame.createOrReplaceTempView("own_sources")
    return frame


def test_a_rule_row_gives_facts_through_sql(spark, sources):
    rows = [("todo", "owner", r"\btodo\((\w+)\):\s*(\w+)", {"who": 1, "what": 2}, True, None, 2), ("todo", "type", r"^int\s+(\w+)", {"name": 1}, None, None, 1), ("other", "x", "x", {}, None, None, None)]
    spark.createDataFrame(rows, plugins.RULES).createOrReplaceTempView("own_rules")
    plugins.create_view(spark, "own_facts", "own_sources", "own_rules", "todo")
    found = spark.sql("SELECT source_file, kind, line, who, what, name FROM own_facts ORDER BY line, who").collect()
    assert list(map(tuple, found)) == [("a.c", "owner", 1, "ann", "x", None), ("a.c", "type", 2, None, None, "y"), ("a.c", "owner", 3, "bob", "z", None), ("a.c", "owner", 3, "cy", "w", None)]
    plugins.create_view(spark, "own_facts", "own_sources", "own_rules", "todo", every=False)
    assert spark.sql("SELECT count(*) FROM own_facts").first()[0] == 3
    assert plugins.rule_facts(sources, []).count() == 0
    assert "Python" not in plugins.rule_facts(sources, plugins.rules_of(spark.table("own_rules"), "todo"))._jdf.queryExecution().executedPlan().toString()


def test_a_function_gives_facts_through_sql(spark, sources):
    def longest(content, source_file):
        if source_file == "c.c":
            raise ValueError("not this one")
        words = content.split()
        return [{"word": max(words, key=len), "size": len(words), "more": 1}] if words else []

    plugins.register(spark, {"longest": plugins.Extractor(longest, ("word", "size"))})
    found = spark.sql("SELECT * FROM extract_facts(TABLE(own_sources) PARTITION BY (source_file), 'longest') ORDER BY source_file").collect()
    assert list(map(tuple, found)) == [("a.c", None, "TODO(ann):", "8"), ("c.c", "ValueError: not this one", None, None)]
    with pytest.raises(Exception, match="no extractor"):
        spark.sql("SELECT * FROM extract_facts(TABLE(own_sources), 'none')").collect()


def test_only_changed_facts_come_out(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", fusion.ROCKSDB)
    schema = "route string, method string, handler string, confidence string, evidence string, seq int"
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def batch(number, *rows):
        (source / f"{number}.json").write_text("\n".join(json.dumps(dict(zip([x.split()[0] for x in schema.split(", ")], r, strict=True))) for r in rows))
        stream = fusion.changed_facts(spark.readStream.schema(schema).json(str(source)), ["route", "method"], cap=2)
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda rows, n: rows.write.mode("append").json(str(out / str(number)))).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["route"], r.get("method"), json.loads(r["rest"])["handler"], r["confidence"], r["evidence"], r["changes"]) for p in (out / str(number)).glob("*.json") for r in map(json.loads, p.read_text().splitlines()))

    first = batch(1, ("/a", "GET", "h2", "low", "e2", 2), ("/a", "GET", "h1", "medium", "e1", 1), ("/b", None, "h", "low", "e", 1))
    assert first == [("/a", "GET", "h1", "medium", ["e1", "e2"], 1), ("/b", None, "h", "low", ["e"], 1)]
    # a restart from the checkpoint each time: known facts stay silent, a higher confidence speaks, evidence beyond the cap doesn't
    assert batch(2, ("/a", "GET", "h9", "low", "e3", 1), ("/c", "PUT", "h", "high", None, 1)) == [("/c", "PUT", "h", "high", [], 1)]
    assert batch(3, ("/b", None, "x", "high", "e", 1)) == [("/b", None, "h", "high", ["e"], 2)]
