"""Facts from bundles that arrive in a folder.

The extractors work on streams as they are; merging keeps one row for a fact over all batches. Each batch writes the next
version of the whole table of facts, so its cost grows with what has been merged before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.fuse import first_wins
from factweave.sources.bundles import BUNDLE


def arriving_sources(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, content and arrived of the files of each new bundle; files seen within ten minutes are skipped."""
    bundles = spark.readStream.schema(BUNDLE).option("multiLine", "true").json(folder)
    files = bundles.select(F.explode("files").alias("f"), F.current_timestamp().alias("arrived")).select(F.coalesce("f.source_file", F.lit("<inline>")).alias("source_file"), F.col("f.content").alias("content"), "arrived")
    return files.where("content IS NOT NULL").withWatermark("arrived", "10 minutes").dropDuplicatesWithinWatermark(["source_file", "content"])


def merge_stream(sources: DataFrame, extract: Callable[[DataFrame], DataFrame], keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Keep, in Parquet folders below `target`, the first row of every fact; each batch writes the next version."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = extract(batch.select("source_file", "content")).withColumn("batch", F.lit(number).cast("long"))
        if number:
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{target}/version={number - 1}"))
        merged = first_wins(fresh.withColumn("order_", F.struct("batch", F.lit(0))), keys, "order_")
        merged.select(fresh.columns).write.mode("overwrite").parquet(f"{target}/version={number}")

    return sources.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, event_type, events and total value, by tumbling windows; works on batches and on streams."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end and events of every session, whose events are closer than the gap."""
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return counted.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
