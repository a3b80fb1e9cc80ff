"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens; tokens under a 0 are ignored, so a substituted word leaves other seeds whole. The
hashes of all seeds of the benchmark are looked up for all seeds of the documents. Around each hit the two token
sequences are compared along their common diagonal; the best stretch (1 for an equal token, -2 for a substituted one)
counts when enough of its tokens are equal.

The benchmark is sent to every task in slices of at most SLICE_TOKENS tokens, after its tokens are counted; a larger
benchmark takes more passes over the documents. Documents are not shuffled.

Edge cases. A null text has no tokens. A benchmark item of fewer tokens than the shortest mask matches nothing. Of equal
stretches the one that begins first in the document is reported. Texts and items that say one word over and over make one
hit for each diagonal. Repeated documents or items give their rows once each. A null item_id stays null.
Empty tables give no pairs, and every document stays. Extra columns of documents pass through clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta
from factweave.llm.shared import stored

MASKS = ("111111", "1111011", "1110111", "11011011", "101101101001", "110010110001001")
SHORTEST = min(map(len, MASKS))
#: Benchmark tokens sent to the tasks at once: with all masks about 60 bytes each.
SLICE_TOKENS = 500_000
#: Equal tokens that a stretch needs, or this share of an item's tokens if that is less.
MATCHED, SHARE = 10, 0.8
SIEVE_BITS = 22
#: Bytes of text searched at once.
BLOCK_BYTES = 2_000_000
#: Hits made at once, before equal diagonals are told apart; tokens of diagonals compared at once.
HITS = 200_000
#: Diagonals of a text and an item that are looked at first.
FIRST_DIAGONALS = 16


def seeds(words: np.ndarray, doc_starts: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every seed that lies within one text."""
    n = np.maximum(np.diff(doc_starts) - len(mask) + 1, 0)
    stops = np.cumsum(n)
    at = np.repeat(doc_starts[:-1] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
    out = np.full(len(at), 2 * salt + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ words[at + k]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return at, out


def previous(keys: np.ndarray, at: np.ndarray, doc_starts: np.ndarray, none: np.uint64) -> np.ndarray:
    """The key one token earlier in the same text; `none` for the first of a text."""
    out = np.r_[np.zeros(1, np.uint64), keys[:-1]] if len(keys) else keys.copy()
    out[np.isin(at, doc_starts)] = none
    return out


def place_between(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """searchsorted(values[low:high], wanted) for each range of sorted values."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = values[np.minimum(mid, len(values) - 1)]
        right = open_ & ((at < wanted) if side == "left" else (at <= wanted))
        low[right] = mid[right] + 1
        left = open_ & ~right
        high[left] = mid[left]
    return low


def chunks(stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of ranges that make about HITS hits each. stops: hits made up to each place."""
    if not len(stops) or not stops[-1]:
        return [], []
    cut = np.flatnonzero(np.diff(stops // HITS)) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(stops)]


class Benchmark:
    """A slice of the benchmark: token hashes of its items, and its seeds in sorted order."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        found = ta.tokens(pa.array(texts, pa.string()))
        self.ids, self.words, self.starts = pa.array(ids, pa.int64()), found.hashes(), found.doc_starts
        self.doc = found.doc
        self.tables = []
        for salt, mask in enumerate(MASKS):
            at, keys = seeds(self.words, self.starts, mask, salt)
            before = previous(keys, at, self.starts, np.uint64(1))
            order = np.lexsort((before, keys))
            sieve = np.zeros(2**SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True
            self.tables.append((mask, keys[order], before[order], at[order], sieve))

    def pairs(self, texts: pa.Array) -> np.ndarray:
        """Rows of (text, item, matched, length, begin in the text, begin in the item), all in tokens."""
        found = ta.tokens(texts)
        words = found.hashes()
        hits = [np.zeros(0, np.int64)]  # text, item and begin of the item on the text's token axis, as one number
        items, longest = max(1, len(self.starts) - 1), int(np.diff(self.starts).max(initial=0))
        for salt, (mask, keys, befores, places, sieve) in enumerate(self.tables):
            if not len(keys):
                continue
            at, own = seeds(words, found.doc_starts, mask, salt)
            maybe = sieve[own >> np.uint64(64 - SIEVE_BITS)]
            before = previous(own, at, found.doc_starts, np.uint64(2))[maybe]
            at, own = at[maybe], own[maybe]
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            some = high > low
            at, before, low, high = at[some], before[some], low[some], high[some]
            # of hits that follow each other on a diagonal only the first is made: those after equal seeds are left out
            same_low, same_high = (place_between(befores, low, high, before, side) for side in ("left", "right"))
            for begin, end in ((low, same_low), (same_high, high)):
                n = end - begin
                stops = np.cumsum(n)
                for a, b in zip(*chunks(stops), strict=True):
                    k = n[a:b]
                    theirs = places[np.repeat(begin[a:b] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                    mine = np.repeat(at[a:b], k)
                    item = self.doc[theirs]
                    hits.append(np.unique((mine - (theirs - self.starts[item]) + (found.doc[mine] + 1) * longest) * items + item))
        place, item = np.divmod(np.unique(np.concatenate(hits)), items)
        doc = np.searchsorted(found.doc_starts[:-1] + np.arange(len(texts)) * longest, place, "right") - 1
        hits = np.column_stack([doc, item, place - (doc + 1) * longest])
        return self.best(found, words, hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))])

    def best(self, found: ta.Tokens, words: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The best stretch of each text and item that has enough equal tokens. hits: sorted, each once.

        The diagonals of a pair are looked at from the first one on, few at first, then more; a pair is done with an item that is
        found whole, as later diagonals can't be better.
        """
        rows, turn = [np.zeros((0, 6), np.int64)], FIRST_DIAGONALS
        while len(hits):
            pair = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1)])
            number = np.arange(len(hits)) - np.repeat(pair, np.diff(np.r_[pair, len(hits)]))
            now = number < turn
            got = self.stretches(found, words, hits[now])
            rows.append(got)
            size = np.diff(self.starts)
            whole = got[got[:, 2] == size[got[:, 1]]]
            hits, turn = hits[~now], 8 * turn
            hits = hits[~np.isin(hits[:, 0] * len(size) + hits[:, 1], whole[:, 0] * len(size) + whole[:, 1])]
        out = np.concatenate(rows)
        out = out[np.lexsort((out[:, 4], -out[:, 2], out[:, 1], out[:, 0]))]
        first = np.r_[True, (out[1:, :2] != out[:-1, :2]).any(axis=1)] if len(out) else np.zeros(0, bool)
        return out[first]

    def stretches(self, found: ta.Tokens, words: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The best stretch on each diagonal, where it has enough equal tokens: as pairs() gives them."""
        doc, item, begin = hits.T
        first = self.starts[item]
        whole = self.starts[item + 1] - first
        shift = np.maximum(0, found.doc_starts[doc] - begin)
        size = np.minimum(whole, found.doc_starts[doc + 1] - begin) - shift
        least = np.minimum(MATCHED, np.maximum(SHORTEST, np.ceil(SHARE * whole).astype(np.int64)))
        out = []
        stops = np.cumsum(size)
        for a, b in zip(*chunks(stops), strict=True):
            n, of = size[a:b], np.arange(a, b)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            same = words[np.repeat(begin[a:b] + shift[a:b], n) + step] == self.words[np.repeat(first[a:b] + shift[a:b], n) + step]
            # sums of each diagonal from a 0 on, end to end; lower by a step from one diagonal to the next, so a running least is the diagonal's own
            heads = np.cumsum(n + 1) - (n + 1)
            sums = np.zeros(int((n + 1).sum()), np.int64)
            inside = np.ones(len(sums), bool)
            inside[heads] = False
            sums[inside] = np.where(same, 1, -2)
            equal = np.zeros(len(sums), np.int64)
            equal[inside] = same
            sums, equal = np.cumsum(sums), np.cumsum(equal)
            row = np.repeat(np.arange(len(n)), n + 1)
            sums -= np.repeat(sums[heads], n + 1)
            drop = 3 * int(n.max(initial=0)) + 1
            least_so_far = np.minimum.accumulate(sums - row * drop) + row * drop
            gain = sums - least_so_far
            right = first_of(gain == np.maximum.reduceat(gain, heads)[row], heads)
            left = first_of(sums == least_so_far[right][row], heads)
            matched = equal[right] - equal[left]
            enough = matched >= least[a:b]
            own, at = of[enough], left[enough] - heads[enough]
            out.append(np.column_stack([doc[own], item[own], matched[enough], (right - left)[enough], begin[own] + shift[own] + at - found.doc_starts[doc[own]], shift[own] + at]))
        return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


def first_of(marked: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The first marked place from each head on."""
    places = np.flatnonzero(marked)
    return places[np.searchsorted(places, heads)]


def slices(benchmark: DataFrame) -> Iterator[tuple[bool, Benchmark]]:
    """The benchmark in parts of bounded size (an item is not split), each with whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (2 * SLICE_TOKENS)))  # a token and its blank take two characters or more
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield k == parts - 1, Benchmark([r.item_id for r in rows], [r.text for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, overlap, doc_token and item_token of every document and item that overlap.

    What a slice of the benchmark finds is written before the next one is taken, so the driver holds one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "matched", "overlap", "doc_token", "item_token"]

    def search(part: Benchmark) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in ta.blocks(batches, most=BLOCK_BYTES):
                pairs = part.pairs(block.column("text"))
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(pairs[:, 0])), part.ids.take(pa.array(pairs[:, 1])), *(pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2, 6))], names)

        return rows.mapInArrow(work, ", ".join(f"{x} long" for x in names))

    found = []
    for last, part in slices(benchmark):
        one = search(part)
        found.append(one if last and not found else stored(one))
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns. Those that a slice leaves are written before the next."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    for last, part in slices(benchmark):

        def work(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for block in ta.blocks(batches, most=BLOCK_BYTES):
                keep = np.ones(block.num_rows, bool)
                keep[part.pairs(block.column("text"))[:, 0]] = False
                yield block.filter(pa.array(keep))

        out = out.mapInArrow(work, out.schema)
        out = out if last else stored(out)
    return out
