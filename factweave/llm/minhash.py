"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles, as 64-bit hashes; its sketch holds the K smallest. Equal sets
are one node. Runs of neighbouring retained values are the keys of inverted lists: at the threshold, sketches that share no
run have a probability of about 1e-8, and of sets that the sketches hold whole there are none (the smallest sets are
listed by single values, too). Nodes of one list
whose sizes allow a link form blocks (components over lists). Within a block, overlaps come from the inverted lists of
retained values, the union sketch estimates the resemblance, and whole sets confirm it exactly. A block of many nodes is
dealt out as pairs of its parts, so no task holds more than two parts. Only a spanning forest of links leaves a task.

Edge cases. A null text is empty; a text without words has no set and links with nothing. A text of fewer than five
words is one shingle. Rows with a null doc_id have sets, but take no part in links. Of rows with one doc_id and several
texts each text is a node. Ties and repeated rows share a node. Empty tables give no rows. Extra columns are ignored by
near_duplicates() and pass through keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta
from factweave.llm.components import stars
from factweave.llm.shared import release, written

K = 64
#: Sets of up to so many values are listed by single values, too.
SMALL = 16
#: Nodes of a part of a block.
PART = 800


def document_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets end to end, each sorted; offsets; and a 64-bit node id of each set."""
    doc, values = ta.shingles(ta.tokens(texts), width)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])] if len(doc) else np.zeros(0, bool)
    doc, values = doc[fresh], values[fresh]
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(ta.mixed(values ^ np.uint64(0x5BD1E995_9E3779B9)), dtype=np.uint64)]
    node = ta.mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)
    return values, offsets, node


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (null without words) and sketch (the K smallest values as bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches):
            values, offsets, node = document_sets(block.column("text"), width)
            n = np.diff(offsets)
            stops = np.minimum(offsets[1:], offsets[:-1] + K)
            sketch = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, mask=n == 0), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, node long, sketch binary")


def run_length(threshold: int) -> int:
    """Retained values in a key: fewer where links share less."""
    return 4 if threshold >= 85 else 3 if threshold >= 80 else 2 if threshold >= 65 else 1


def least_estimate(threshold: int) -> float:
    """Share of the union sketch below which a link is 5.7 deviations off."""
    t = threshold / 100
    return t - 5.7 * (t * (1 - t) / K) ** 0.5


def hashed_runs(values: np.ndarray, run: int) -> np.ndarray:
    key = np.full(max(len(values) - run + 1, 0), run, np.uint64)
    for k in range(run):
        key = (key ^ values[k : k + len(key)]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(31)
    return key


def runs_of(nodes: DataFrame, threshold: int) -> DataFrame:
    """key, node and n for every run of retained values."""
    run = run_length(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = [np.frombuffer(x, np.uint64) for x in batch.column("sketch").to_pylist()]
            keys = [np.concatenate([hashed_runs(x, run), hashed_runs(x, 1)]) if len(x) <= SMALL and run > 1 else hashed_runs(x, run) for x in sketch]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column("node").take(at), batch.column("n").take(at)], ["key", "node", "n"])

    return nodes.select("node", "n", "sketch").mapInArrow(work, "key long, node long, n long")


class Forest:
    """Union-find over 0 ... n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def confirmed(sets: list[np.ndarray], left: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, where |A & B| * 100 >= threshold * |A | B|. Pairs of two sets of the same
    side, by `left`, are left to another task unless all are of one side."""
    m, least = len(sets), least_estimate(threshold)
    sizes = np.array([len(x) for x in sets], np.int64)
    sketch = [x[:K] for x in sets]
    flat, owner = np.concatenate(sketch), np.repeat(np.arange(m), [len(x) for x in sketch])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    stop = np.r_[begin[1:], len(flat)]
    shared = np.zeros((m, m), np.int16)
    for a, b in zip(begin[stop - begin > 1].tolist(), stop[stop - begin > 1].tolist(), strict=True):
        own = owner[a:b]
        shared[own[:, None], own[None, :]] += 1
    whole = (sizes <= K)[:, None] & (sizes <= K)[None, :]
    enough = np.where(whole, 100 * shared.astype(np.int64) >= threshold * (sizes[:, None] + sizes[None, :] - shared), shared >= least * np.minimum(K, np.minimum(sizes[:, None], sizes[None, :])))
    enough &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :])
    if left.any() and not left.all():
        enough &= left[:, None] != left[None, :]
    first, second = np.nonzero(np.triu(enough, 1))
    forest, links = Forest(m), []
    padded = np.full((m, K), np.iinfo(np.uint64).max, np.uint64)
    for k, x in enumerate(sketch):
        padded[k, : len(x)] = x
    for at in range(0, len(first), 20_000):
        a, b = first[at : at + 20_000], second[at : at + 20_000]
        joint = np.sort(np.concatenate([padded[a], padded[b]], axis=1), axis=1)
        twice = np.c_[joint[:, 1:] == joint[:, :-1], np.zeros(len(a), bool)] & (joint < np.iinfo(np.uint64).max)
        rank = np.cumsum(np.c_[np.ones(len(a), bool), joint[:, 1:] != joint[:, :-1]], axis=1)
        estimate = (twice & (rank <= K)).sum(axis=1) / np.minimum(K, np.maximum(sizes[a], sizes[b]))
        likely = np.argsort(-estimate, kind="stable")
        for k in likely[estimate[likely] >= least].tolist():
            x, y = int(a[k]), int(b[k])
            if forest.root(x) != forest.root(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                    forest.join(x, y)
                    links.append((x, y))
    return links


def links_within_blocks(members: DataFrame, threshold: int, bundles: int) -> DataFrame:
    """Edges u, v. members: block, size (of the block), node and values (the set as bytes). Small blocks share a task by so many bundles."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    rows = members.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select(
        F.when(F.col("size") > PART // 8, F.xxhash64("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bundles).cast("long"))).alias("bundle"),
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "block", "node", "values", (F.col("part") < F.col("other")).alias("left"), (F.col("part") == F.col("other")).alias("same"),
    )

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in pdf.groupby("block", sort=False):
            if len(group) > 1:
                node = group["node"].to_numpy()
                side = (group["left"] if (group["i"] != group["j"]).any() else group["same"]).to_numpy()
                found += [(node[a], node[b]) for a, b in confirmed([np.frombuffer(x, np.uint64) for x in group["values"]], side, threshold)]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.groupBy("bundle", "i", "j").applyInPandas(work, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for every document.

    threshold: the least resemblance in hundredths.
    """
    signed = sketches(docs, width).checkpoint()
    nodes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    by_size = Window.partitionBy("key").orderBy("n", "node")
    near = runs_of(nodes, threshold).withColumn("apart", F.coalesce(100 * F.lag("n").over(by_size) < threshold * F.col("n"), F.lit(True)).cast("int"))
    near = near.withColumn("stretch", F.sum("apart").over(by_size))
    pivots = near.withColumn("v", F.first("node").over(Window.partitionBy("key", "stretch").orderBy("n", "node")))
    blocks = stars(pivots.where("node <> v").select(F.col("node").alias("u"), "v"))
    members = blocks.unionAll(blocks.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("root", "block")
    members = members.join(members.groupBy("block").agg(F.count("*").alias("size")), "block")
    # written with their size, by which Spark may spare the texts a shuffle
    members = written(members.join(nodes.select("node", "first_id"), "node"))

    def take_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches):
            values, offsets, node = document_sets(block.column("text"), width)
            keep = np.flatnonzero(node == block.column("node").to_numpy())
            sets = [values[offsets[k] : offsets[k + 1]].tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([block.column(x).take(pa.array(keep)) for x in ("block", "size", "node")] + [pa.array(sets, pa.binary())], ["block", "size", "node", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text")).join(members, "first_id")
    sets = texts.select("block", "size", "node", "text").mapInArrow(take_sets, "block long, size long, node long, values binary")
    roots = stars(links_within_blocks(sets, threshold, max(4096, members.count() // 100)))
    release(docs.sparkSession)
    nodes = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = nodes.join(groups, "root").select("node", "component_id")
    linked = F.col("doc_id").isNotNull() & F.col("node").isNotNull()
    out = signed.select("doc_id", "n_shingles", "node").join(final, "node", "left").withColumn("component_id", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: that of the smallest doc_id.

    Rows with a null doc_id stay. Of several rows with the kept doc_id all stay.
    """
    gone = near_duplicates(docs, threshold, width).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = written(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
