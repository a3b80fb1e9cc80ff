"""Session defaults for tests, benchmarks and local work; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "factweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, UTC and no UI."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The same rows, written to a new shared folder and read again."""
    folder = shared_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def spread(rows: DataFrame) -> DataFrame:
    """Rows read from files, for work that is long for each row: over all cores where the files give fewer partitions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows from which long work for each follows: over all cores, some tasks for each, however few row groups their files have."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)
