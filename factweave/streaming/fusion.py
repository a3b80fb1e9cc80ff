"""Fusion of facts as they arrive, with the state of each fact kept by its key; only facts that changed come out.

What a batch costs depends on its own rows: a fact's state is read and written where the fact arrives again, and no table of all
facts is rewritten. State that nothing has touched for `expiry` goes. Needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass), which keeps state in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factweave.functions import columns as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "rest string, rank int, evidence array<string>, changes bigint"


class Fusion(StatefulProcessor):
    """Keeps the first row's other columns, the highest confidence, and the first `cap` different pieces of evidence."""

    def __init__(self, cap: int, expiry_ms: int | None):
        self.cap, self.expiry_ms = cap, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fact = handle.getValueState("fact", STATE, self.expiry_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = tuple(self.fact.get()) if self.fact.exists() else None
        rest, rank, evidence, changes = old if old else (None, -1, [], 0)
        before = (rest, rank, list(evidence))
        parts = pd.concat(list(rows)).sort_values("seq", kind="stable")
        rest = parts["rest"].iloc[0] if old is None else rest
        rank = max(rank, int(parts["rank"].max()))
        evidence = list(dict.fromkeys([*evidence, *(e for e in parts["evidence"] if e is not None)]))[: self.cap]
        if (rest, rank, evidence) != before:
            self.fact.update((rest, rank, evidence, changes + 1))
            yield pd.DataFrame({"key": [key[0]], "rest": [rest], "rank": [rank], "evidence": [evidence], "changes": [changes + 1]})

    def close(self) -> None:
        pass


def changed_facts(facts: DataFrame, keys: list[str], *, cap: int = 10, expiry_ms: int | None = None) -> DataFrame:
    """The stream of facts that a batch has added or changed: keys, `rest` (the other columns of the fact's first row, as JSON), confidence,
    evidence and changes (from 1).

    facts: a stream with the keys, confidence, evidence, seq (the order of rows that arrive together) and more. Nulls in keys are equal.
    """
    other = [c for c in facts.columns if c not in (*keys, "confidence", "evidence", "seq")]
    as_json = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = facts.select(as_json(keys).alias("key"), as_json(other or [F.lit(None).cast("string").alias("none")]).alias("rest"), C.confidence_rank(F.col("confidence")).cast("int").alias("rank"), "evidence", F.to_json(F.struct("seq")).alias("seq"))
    merged = rows.groupBy("key").transformWithStateInPandas(Fusion(cap, expiry_ms), f"key string, {STATE}", "Update", "None" if expiry_ms is None else "ProcessingTime")
    kinds = ", ".join(f"`{k}` {facts.schema[k].dataType.simpleString()}" for k in keys)
    named = merged.withColumn("k", F.from_json("key", kinds))
    return named.select(*(F.col(f"k.`{k}`").alias(k) for k in keys), "rest", C.confidence_label(F.col("rank")).alias("confidence"), "evidence", "changes")
