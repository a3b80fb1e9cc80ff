"""Where jobs cut their lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(named)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, written as compressed Parquet in the shared folder and read again."""
    folder = shared_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def written(frame: DataFrame) -> DataFrame:
    """stored(), for large tables: the shuffle files behind them may go."""
    out = stored(frame)
    release(frame.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    It does so when the driver collects garbage; the first collection only lets go of the plans that held them.
    """
    for _ in range(6):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
