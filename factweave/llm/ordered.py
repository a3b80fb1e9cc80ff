"""Rows of large groups in order, without a task that holds a group: places by range partitions, digests by streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factweave.llm.shared import stored


def name(*parts: Column) -> Column:
    """A 128-bit name of what the parts are, end to end."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turn_name(role: Column, text: Column) -> Column:
    """A 128-bit name of a role and a text; the length of the role keeps them apart."""
    return name(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"))


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `pos`, their place (from 0) in their group by `order`; nulls come first, and a null group is a group.

    group: a column of type long. Rows are dealt by ranges of group and order together, so a group of any size goes to as many
    tasks as its rows need; rows alike in everything are told apart by a number. What a group has in earlier partitions is
    one row for each partition that begins inside a group, and is broadcast.
    """
    schema = StructType([*rows.schema.fields, StructField("part_", LongType(), False), StructField("seq_", LongType(), False)])
    dealt = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(group, *order, "tie_").sortWithinPartitions(group, *order, "tie_").drop("tie_")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(group)
            null, value = np.asarray(column.is_null()), np.asarray(column.fill_null(0))
            starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (null[1:] != null[:-1])])
            seq = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
            if last == (bool(null[0]), int(value[0])):
                seq[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = (bool(null[-1]), int(value[-1])), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(seq, pa.int64())], [*batch.schema.names, "part_", "seq_"])

    numbered = stored(dealt.mapInArrow(number, schema))
    runs = numbered.groupBy(F.col(group).alias("group_"), F.col("part_").alias("in_")).agg(F.count("*").alias("n"))
    before = runs.withColumn("before", F.sum("n").over(Window.partitionBy("group_").orderBy("in_")) - F.col("n")).where("before > 0").drop("n")
    met = numbered.join(F.broadcast(before), F.col(group).eqNullSafe(F.col("group_")) & (F.col("part_") == F.col("in_")), "left")
    return met.withColumn("pos", F.col("seq_") + F.coalesce("before", F.lit(0))).select(*rows.columns, "pos")


def digests(rows: DataFrame, group: str, order: list[str], separator: str) -> DataFrame:
    """group and sha256 (lowercase hex) of the group's `piece`s in order, joined by the separator.

    A digest takes its bytes one after the other, so a group is one task's; that task reads the sorted pieces as a stream
    and holds a batch of them.
    """
    kind = rows.schema[group].dataType.simpleString()
    dealt = rows.select(group, *order, "piece").repartition(group).sortWithinPartitions(group, *order).select(group, "piece")
    between = separator.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, last, digest = False, None, hashlib.sha256()
        for batch in batches:
            keys, found = [], []
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not live or key != last:
                    if live:
                        keys.append(last)
                        found.append(digest.hexdigest())
                    live, last, digest = True, key, hashlib.sha256()
                else:
                    digest.update(between)
                digest.update(piece.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], [group, "sha256"])
        if live:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([digest.hexdigest()])], [group, "sha256"])

    return dealt.mapInArrow(work, f"{group} {kind}, sha256 string")
