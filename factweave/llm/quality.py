"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its own diagonal. The score is
the logistic of the difference of the two log densities (plus priors); each density is a Mahalanobis distance
through a Cholesky factor that is made once.

Edge cases. A null text is empty and is scored like any other. Rows are scored one by one, so repeated rows and ties
get equal scores. Labels that are null, or that contradict each other for one doc_id, teach nothing. Without labels of
both classes every score is 0.5, and keep_good(), which then knows nothing against any document, keeps all. Tables without rows give no rows. Extra columns of documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta

#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "words", "word_length", "symbols", "capitals", "bars", "marks", "digits", "distinct", "repeats", "top_word", "symbol_ends", "line_words", "stops", "inner_capitals",
)


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    raw, offsets = ta.text_buffers(texts)
    found = ta.tokens(texts)
    rows = len(offsets) - 1

    def per_text(table: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(table[raw], dtype=np.int64)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def kind(codes: str | bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(codes if isinstance(codes, bytes) else codes.encode())] = True
        return table

    upper, lower, digit = kind(bytes(range(65, 91))), kind(bytes(range(97, 123))), kind("0123456789")
    letter = upper | lower | (np.arange(256) >= 128)
    plain = letter | digit | ta.SPACE | kind(".,'-")
    size = np.diff(offsets).astype(float)
    n = np.diff(found.doc_starts).astype(float)
    hashes = found.hashes()
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (found.doc[1:] == found.doc[:-1])] if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, found.doc))
    by_doc, by_hash = found.doc[order], hashes[order]
    fresh = np.r_[True, (by_doc[1:] != by_doc[:-1]) | (by_hash[1:] != by_hash[:-1])] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    counts = np.diff(np.r_[at, len(order)])
    distinct = np.bincount(by_doc[at], minlength=rows).astype(float)
    top = np.zeros(rows)
    np.maximum.at(top, by_doc[at], counts)
    tail = raw[found.ends - 1] if len(found.ends) else np.zeros(0, np.uint8)
    symbol_ends = np.bincount(found.doc[(~plain)[tail]], minlength=rows)
    stop_ends = np.bincount(found.doc[kind(".?")[tail]], minlength=rows)
    inside = np.r_[False, upper[raw[1:]] & letter[raw[:-1]]] if len(raw) else np.zeros(0, bool)
    inner_sums = np.r_[0, np.cumsum(inside, dtype=np.int64)]
    inner = inner_sums[offsets[1:]] - inner_sums[offsets[:-1]]
    lines = per_text(kind("\n")) + 1
    share = lambda x, of: np.log((x + 0.5) / (np.maximum(of - x, 0) + 0.5 + 0.01 * of))  # noqa: E731  a logit that short texts don't stretch
    letters = per_text(letter)
    return np.column_stack([
        np.log1p(n), np.log1p(size / np.maximum(n, 1)), share(per_text(~plain), size), share(per_text(upper), letters), share(per_text(kind("|")), n), share(per_text(kind("!")), n), share(per_text(digit), size),
        np.log1p(distinct) / np.maximum(np.log1p(n), 0.5), share(np.bincount(found.doc[same], minlength=rows), n), share(np.maximum(top - 1, 0), n), share(symbol_ends, n), np.log1p(n / lines), share(stop_ends, n), share(inner, letters),
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `stats`, an array of the statistics of the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches):
            stats = document_statistics(block.column("text"))
            flat = pa.array(stats.ravel(), pa.float64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), rows], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances with their inverses, and log priors."""

    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    priors: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        logs = []
        for mean, factor, inverse, prior in zip(self.means, self.factors, self.inverses, self.priors, strict=True):
            z = inverse @ (stats - mean).T
            logs.append(prior - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, *, pooled: float = 0.1, diagonal: float = 0.1) -> Discriminant | None:
    """Moments of both classes over every labelled row for which `learn` (on doc_id) holds; None unless both have rows.

    pooled and diagonal are the weights of the pooled covariance and of the own diagonal in each class covariance. What
    reaches the driver is two rows of sums, whatever the number of documents.
    """
    d = len(STATISTICS)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    known = stats.where(learn).join(marks, "doc_id").select("quality", "stats")

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for part in parts:
            if len(part):
                x = np.stack(part["stats"].to_numpy())
                for c in (0, 1):
                    own = x[part["quality"].to_numpy() == c]
                    sums[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pd.DataFrame({"quality": np.repeat([0, 1], sums.shape[1]), "place": np.tile(np.arange(sums.shape[1]), 2), "value": sums.ravel()})

    rows = known.mapInPandas(moments, "quality int, place int, value double").groupBy("quality", "place").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for row in rows:
        sums[row.quality, row.place] = row.value
    n = sums[:, 0]
    if not n.all():
        return None
    means = sums[:, 1 : d + 1] / n[:, None]
    own = sums[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    joint = (own * n[:, None, None]).sum(axis=0) / n.sum()
    factors = []
    for c in (0, 1):
        mix = (1 - pooled - diagonal) * own[c] + pooled * joint + diagonal * np.diag(np.diag(own[c]))
        factors.append(np.linalg.cholesky(mix + np.eye(d) * (1e-4 + 1 / (n[c] + 1))))
    return Discriminant(means, np.stack(factors), np.linalg.inv(np.stack(factors)), np.log(n / n.sum()))


def scored(stats: DataFrame, model: Discriminant | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold up) of every row."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                score = model.scores(np.stack(part["stats"].to_numpy()))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return stats.mapInPandas(work, "doc_id long, score double, predicted int")


def held_out(doc_id: Column, modulus: int = 4) -> Column:
    """Rows that never teach: crc32 of the id's text leaves 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = with_statistics(docs).checkpoint()
    model = fit(stats, labels, ~held_out(F.col("doc_id")))
    return scored(stats, model, threshold).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    The text is scored where it is read, so it is not shuffled; a document's own columns pass through. Only documents that
    may teach have statistics taken for the model.
    """
    teaches = ~held_out(F.col("doc_id").cast("long"))
    model = fit(with_statistics(docs.where(teaches)).checkpoint(), labels, teaches)
    if model is None:
        return docs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches):
            yield block.filter(pa.array(model.scores(document_statistics(block.column("text"))) >= threshold))

    return docs.mapInArrow(work, docs.schema)
