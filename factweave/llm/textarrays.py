"""Texts of an Arrow batch as flat numpy arrays: bytes, token bounds and token hashes.

A token is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK_BYTES = 4_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: A fixed random odd number for each byte.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spans above this size are hashed one by one.
LONG_SPAN = 256


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len(texts) + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for start, stop in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, stop - start)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that low and high bits are both usable."""
    out = values ^ (values >> np.uint64(33))
    out = out * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out = out * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


@dataclass
class Tokens:
    """Tokens of a block in text order."""

    data: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index of the text of each token
    doc_starts: np.ndarray  # for each text its first token; one more entry at the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's bytes."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, eight bytes at a time.

    Each step is a bijection of the eight bytes, so spans of up to eight bytes never collide with others of their size.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - starts
    out = mixed(size.astype(np.uint64) + _BASE)
    masks = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    left = np.where(size > LONG_SPAN, 0, size)
    live = np.flatnonzero(left > 0)
    at, left = starts[live], left[live]
    while len(live):
        out[live] = mixed(out[live] ^ (eight[at] & masks[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    whole = memoryview(np.ascontiguousarray(data))
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = xxhash.xxh3_64_intdigest(whole[int(starts[k]) : int(ends[k])])
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[start:start + size] equals data[other:other + size], for each span."""
    differ = np.zeros(len(starts), bool)
    ends = np.cumsum(sizes)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    wrong = data[np.repeat(starts, sizes) + step] != data[np.repeat(others, sizes) + step]
    differ[np.searchsorted(ends, np.flatnonzero(wrong), side="right")] = True
    return ~differ


def tokens(texts: pa.Array) -> Tokens:
    """All tokens of the texts."""
    raw, offsets = text_buffers(texts)
    data = LOWER[raw]
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, solid[:-1]] if len(data) else solid
    first = solid & (~before | edge[:-1])
    after = np.r_[solid[1:], False] if len(data) else solid
    last = solid & (~after | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc_starts = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(doc_starts))
    return Tokens(data, starts, ends, doc, doc_starts)


def shingles(found: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of `width` tokens; a text of fewer tokens is one run."""
    words = found.hashes()
    n = np.diff(found.doc_starts)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), runs)
    begin = np.repeat(found.doc_starts[:-1] - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(len(doc))
    stop = np.repeat(found.doc_starts[1:], runs)
    out = np.full(len(doc), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for k in range(width):
        here = begin + k < stop
        word = words[np.minimum(begin + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        out = np.where(here, mixed(out * _BASE + word), out)
    return doc, out
