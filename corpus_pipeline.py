"""The corpus pipeline: quality, line dedup, near dedup, decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontaminate, linededup, minhash, quality
from factweave.llm.shared import ensure_checkpoints, shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier learns from the labels table."""
    ensure_checkpoints(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, or nearly stand, earlier; a document of which nothing is left goes."""
    ensure_checkpoints(spark)
    return linededup.keep_fresh(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    ensure_checkpoints(spark)
    return minhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and their number."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_documents), ("line_dedup", fresh_lines), ("near_dedup", one_of_each), ("decontaminate", uncontaminated), ("encode", encoded)]

#: A classifier, an edit join and merges are beyond SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    ensure_checkpoints(spark)
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
