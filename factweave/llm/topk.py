"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into 1, 4, 16 ... segments. From each segment's mean and the norm of what is left beside it, the
Cauchy-Schwarz inequality bounds an inner product from above (so a distance from below). Candidates whose bound, coarse to
fine, stays below a query's k-th best score so far are passed over; the others are scored exactly.

Queries are taken in blocks of bounded size; each task scans its candidates for a whole block and returns k rows a query.
The rows of a block are written to the shared folder before the next block is taken, so the driver holds one block.

Edge cases. Vectors that are null, or hold null or non-finite components, take no part. Only vectors of the query's length
are compared. Components so large that 256 times them isn't finite count as non-finite; scores beyond 64 bits count as the
greatest or least number of 64 bits. Rows with the query's vec_id are its own and are left out; of several query rows with one vec_id the
smallest vector asks. Ties go to the smaller vec_id, repeated candidate rows count one by one. Empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import shared_folder, stored

SCHEMA = "query_id long, vec_id long, score long"
#: Queries that a task holds at once; their vectors are what is sent to every task.
QUERY_BLOCK = 2048
#: Candidates bounded at once.
CHUNK = 1024
#: The greatest score.
MOST = 2**63 - 1


def resolved(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, per segment mean and norm of the rest, scaled so that products of rows bound inner products."""
    parts = np.array_split(x, segments, axis=1)
    means = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    rests = [np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts]
    return np.column_stack(means + rests)


class Search:
    """The best k of all candidates seen so far, for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        dim = vectors.shape[1]
        self.levels = [(s, resolved(vectors, s)) for s in (1, 4, 16) if 2 * s < dim]
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.best = [np.zeros((0, 2), np.int64)] * len(ids)  # rows of -score, id
        self.least = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        exact = np.abs(x).max(initial=0) * np.abs(self.vectors).max(initial=0) * x.shape[1] < 2**52
        slack = 1 + 1e-9 * self.norms[:, None] * np.sqrt((x**2).sum(axis=1))[None, :] if np.isfinite(self.least).any() else None
        alive = np.ones((len(self.ids), len(ids)), bool)
        if slack is not None and exact:  # bounds of very large components would overflow
            for segments, own in self.levels:
                some = alive.any(axis=0)
                if not some.any():
                    return
                bound = own @ resolved(x[some], segments).T
                alive[:, some] &= bound + slack[:, some] >= self.least[:, None]
        for q in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[q] & (ids != self.ids[q]))
            if not len(at):
                continue
            if exact:
                score = (x[at] @ self.vectors[q]).astype(np.int64)
            else:
                score = np.array([max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(row, self.vectors[q], strict=True)))) for row in x[at]], np.int64)
            rows = np.concatenate([self.best[q], np.column_stack([-score, ids[at]])])
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))[: self.k]]
            self.best[q] = rows
            if len(rows) == self.k:
                self.least[q] = -rows[-1, 0]


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id and vec: floor(scale * x) of each component as a double, of vectors that take part."""
    vec = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    fine = F.col(vector_column).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("vec")).where("vec_id IS NOT NULL")


def matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each vector length in a batch."""
    lists = batch.column("vec")
    sizes = np.diff(lists.offsets.to_numpy())
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    flat = lists.values.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], flat[starts[at][:, None] + np.arange(size)[None, :]]


def top_k(vectors: DataFrame, *, is_query: str, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every row for which `is_query`, an SQL condition on vec_id."""
    rows = whole_vectors(vectors, id_column, vector_column, scale)
    queries = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    folder = found = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()
        by_size: dict[int, list] = {}
        for row in own:
            by_size.setdefault(len(row.vec), []).append(row)
        block = {size: (np.array([r.vec_id for r in some]), np.array([r.vec for r in some], float).reshape(len(some), size)) for size, some in by_size.items()}

        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searches = {size: Search(ids, vecs, k) for size, (ids, vecs) in block.items()}
            for batch in batches:
                for ids, x in matrix(batch):
                    for at in range(0, len(ids), CHUNK):
                        if x.shape[1] in searches:
                            searches[x.shape[1]].see(ids[at : at + CHUNK], x[at : at + CHUNK])
            for search in searches.values():
                for q, best in zip(search.ids, search.best, strict=True):
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(best[:, 1]), pa.array(-best[:, 0])], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(work, SCHEMA)
        if n_blocks > 1:
            folder = folder or shared_folder(vectors.sparkSession)
            found.write.mode("append").parquet(folder)
    if folder:
        found = vectors.sparkSession.read.schema(SCHEMA).parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
