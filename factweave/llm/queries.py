"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, chat, ctw, decontaminate, linededup, maintext, minhash, prefixtrie, quality, repair, simhash, substrings, topk
from factweave.llm.shared import ensure_checkpoints, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoints(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@registered
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.main_text(table(spark, sf_dir, "pages"))


@registered
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all turns and of the text under the loss mask, read back from the formatted windows."""
    return chat.read_back(chat.windows(chat.with_escape_case(spark, table(spark, sf_dir, "conversations"))))


@registered
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query="vec_id % 50 = 0")


ORACLE["op6_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@registered
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap, with the place of the overlap."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept, for every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


@registered
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines, links to other line texts and a digest of what is kept, for every document."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@registered
def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and a digest of what is left, for every document."""
    return substrings.repeated_spans(table(spark, sf_dir, "documents"), length=200)


@registered
def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and context-tree score of every document."""
    return ctw.scores(table(spark, sf_dir, "documents"))


@registered
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


@registered
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a digest of the repaired turns of every conversation."""
    return repair.repair(table(spark, sf_dir, "conversations"))
