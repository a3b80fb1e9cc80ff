"""Fusion of facts: keyed merging where the first row wins and evidence is kept in order.

The order is a `seq` column that every extractor emits; nothing relies on the order of rows. Both forms aggregate before
they shuffle, and a key's evidence is capped where the caller says so: within a page or bundle, whose facts are few, after it is
gathered; for keys that many rows share (`bounded`), by ranks, which every task cuts to the cap before it sends them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C


def first_wins(facts: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row for each key (nulls are equal): the one with the smallest seq."""
    rest = [c for c in facts.columns if c not in keys]
    merged = facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("first"))
    return merged.select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest if c != seq))


def first_evidence(facts: DataFrame, keys: list[str], cap: int, *, seq: str = "seq", evidence: str = "evidence") -> DataFrame:
    """The first `cap` different pieces of evidence of each key (nulls are equal), in order.

    Equal pieces become one before the shuffle, and the ranks are limited in each task before the rows of a key meet, so what a key
    gathers is `cap` rows from each task, however many it has.
    """
    pieces = facts.groupBy(*keys, evidence).agg(F.min(seq).alias("seq_"))
    kept = capped(pieces, keys, cap, ["seq_"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq_", F.col(evidence).alias("x")))), lambda p: p["x"])
    return kept.groupBy(*keys).agg(ordered.alias(evidence))


def merge_evidence(
    facts: DataFrame, keys: list[str], *, seq: str = "seq", evidence: str = "evidence", first: tuple[str, ...] = (), known: tuple[str, ...] = (), sources: str | None = None, confidence: str | None = None, lists: tuple[str, ...] = (), cap: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """One row for each key.

    first: columns of the smallest seq. known: first value that isn't null. sources: distinct values, sorted, joined by "|".
    confidence: the highest label. lists: arrays united in order. evidence: distinct in order, at most `cap`. bounded: with a cap, take the
    evidence by first_evidence() and join it to the rest, which reads the facts twice.
    """
    if bounded and cap:
        found = first_evidence(facts, keys, cap, seq=seq, evidence=evidence)
        if not (first or known or sources or confidence or lists):
            return found
        no_evidence = facts.withColumn(evidence, F.lit(None).cast(facts.schema[evidence].dataType))
        rest = merge_evidence(no_evidence, keys, seq=seq, evidence=evidence, first=first, known=known, sources=sources, confidence=confidence, lists=lists, cap=1).drop(evidence)
        own = found.select(*(F.col(k).alias(f"{k}_") for k in keys), evidence)
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
        return rest.join(own, same).drop(*(f"{k}_" for k in keys))
    aggregates = [F.min_by(c, seq).alias(c) for c in first]
    aggregates += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in known]
    if sources:
        aggregates.append(F.array_join(F.sort_array(F.collect_set(sources)), "|").alias(sources))
    if confidence:
        aggregates.append(C.confidence_label(F.max(C.confidence_rank(F.col(confidence)))).alias(confidence))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(c).alias("x")))), lambda p: p["x"])
    aggregates += [F.array_distinct(F.flatten(ordered(c))).alias(c) for c in lists]
    seen = F.array_distinct(ordered(evidence))
    aggregates.append((F.slice(seen, 1, cap) if cap else seen).alias(evidence))
    return facts.groupBy(*keys).agg(*aggregates)


def capped(rows: DataFrame, keys: list[str], limit: int, order: list[str]) -> DataFrame:
    """The first `limit` rows of each key."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_") <= limit).drop("rank_")


def bucket_counts(facts: dict[str, DataFrame]) -> DataFrame:
    """bucket and facts: the size of each fact table."""
    parts = [frame.select(F.lit(name).alias("bucket")) for name, frame in facts.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole.groupBy("bucket").agg(F.count("*").alias("facts"))
