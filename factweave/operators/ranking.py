"""Numbers by order over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.session import shared_folder

#: Bits of monotonically_increasing_id() below the partition's number.
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with `name`, their number (from 0) by `order`; equal rows come in any order.

    Rows are sorted in ranges and written; what stands before a range is a sum over one row for each partition, which is broadcast.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()).write.parquet(folder)
    sorted_rows = spark.read.parquet(folder)
    part = F.shiftright("at_", ROW_BITS)
    sizes = sorted_rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    met = sorted_rows.withColumn("part_", part).join(F.broadcast(before), "part_")
    return met.select(*rows.columns, (F.col("before_") + F.col("at_").bitwiseAND((1 << ROW_BITS) - 1)).alias(name))
