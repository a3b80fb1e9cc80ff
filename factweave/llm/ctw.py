"""Language-model scores by context-tree weighting over bytes.

A text is its tokens in lower case with one blank between them and a line end after the last. Each byte is eight binary
decisions; each decision has a tree over the preceding DEPTH bytes, latest first. A node's counts a, b give its
Krichevsky-Trofimov estimate; the weighted probability of a node is half its own estimate and half the product of its
children's. Once the counts are known, a decision's probability is a mixture of the estimates of all depths on its path,
with weights that follow from those probabilities.

Jobs. Tasks count (context, byte) pairs of the training texts and send the counts, packed, by a hash of the two latest context
bytes. A bucket holds all deeper nodes below its contexts; of the nodes of depth 1 and 0, at most 256 x 256 sums are
gathered. Blocks of documents, whose texts travel compressed, then send their distinct pairs, get a logarithm for each,
and add them up. Counts of tokens for the baseline take the same way. So no job holds the counts of the whole corpus in
one place.

Edge cases. A null or empty text is a line end alone. Bytes and contexts that training never met have estimates of 1/2
a bit. Repeated rows count each time and score alike. Rows with a null doc_id are training rows. Without training rows
N and V are 0 and every byte costs eight bits. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta
from factweave.llm.shared import release

#: Context bytes. With the coded one they fill a 64-bit key.
DEPTH = 7
#: Texts and bytes worked on at once.
MOST_TEXTS, SLICE = 60_000, 1_500_000
#: Bytes of text in a block of documents, and for each bucket.
BLOCK, PER_BUCKET = 24_000_000, 16_000_000
#: Distinct pairs that a task holds before it sends them, and bytes of text that it holds before it packs them.
HELD, PACKED = 2_000_000, 12_000_000
#: Distinct pairs whose trees are worked on at once; those of two latest bytes stay together.
TREE = 200_000
END = np.uint64(0xE0D0_E0D0_E0D0_E0D1)

LN2 = math.log(2)
_SMALL = 4096
_HALVES = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; exact to rounding from a few thousand up."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def table(values: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
        out = values[np.minimum(n, _SMALL - 1)]
        many = n >= _SMALL
        out[many] = _log_gamma(n[many] + shift)
        return out

    return table(_HALVES, a, 0.5) + table(_HALVES, b, 0.5) - math.log(math.pi) - table(_WHOLES, a + b, 1.0)


@dataclass
class Level:
    """Contexts of one depth: entries are distinct (context, byte), sorted."""

    codes: np.ndarray
    counts: np.ndarray
    up: np.ndarray | None  # for each entry the entry of the next lower depth


@dataclass
class Nodes:
    """The nodes that entries of a level pass at one decision."""

    of_entry: np.ndarray
    first: np.ndarray  # first entry of each node
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # logarithms
    estimate: np.ndarray


def levels_of(keys: np.ndarray, counts: np.ndarray, lowest: int) -> list[Level]:
    """Levels DEPTH ... lowest. keys: sorted, distinct."""
    out = [Level(keys, counts, None)]
    for _ in range(DEPTH - lowest):
        level = out[-1]
        lower = (level.codes >> np.uint64(16)) << np.uint64(8) | level.codes & np.uint64(255)
        codes, up = np.unique(lower, return_inverse=True)
        level.up = up.astype(np.int32) if len(codes) < 2**31 else up
        out.append(Level(codes, np.bincount(up, weights=level.counts, minlength=len(codes)).astype(np.int64), None))
    return out


def nodes_of(levels: list[Level], j: int) -> list[Nodes]:
    """For each level the nodes of decision j, with their weighted probabilities."""
    out: list[Nodes] = []
    for depth, level in enumerate(levels):
        ident = level.codes >> np.uint64(8 - j)
        fresh = np.r_[True, ident[1:] != ident[:-1]] if len(ident) else np.zeros(0, bool)
        node, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        ones = ((level.codes >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
        b = np.add.reduceat(level.counts * ones, first) if len(first) else level.counts[:0]
        a = (np.add.reduceat(level.counts, first) if len(first) else level.counts[:0]) - b
        estimate = log_kt(a, b)
        weighted = estimate
        if out:
            below = np.bincount(node[levels[depth - 1].up[out[-1].first]], weights=out[-1].weighted, minlength=len(first))
            unlike = np.flatnonzero(estimate != below)  # nodes met once are all alike
            weighted = estimate.copy()
            weighted[unlike] = np.logaddexp(estimate[unlike], below[unlike]) - LN2
        out.append(Nodes(node.astype(np.int32) if len(first) < 2**31 else node, first, a, b, weighted, estimate))
    return out


def bits_given(levels: list[Level]) -> Iterator[tuple[int, np.ndarray]]:
    """For each bit position the probability of each key's bit, mixed over the depths of the levels."""
    byte = levels[0].codes & np.uint64(255)
    for j in range(8):
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        entry, mix = np.arange(len(byte)), None
        for level, nodes in zip(levels, nodes_of(levels, j), strict=True):
            at = nodes.of_entry[entry]
            own = ((nodes.ones + 0.5) / (nodes.zeros + nodes.ones + 1.0))[at]
            if mix is None:
                mix = own
            else:
                stop = np.exp(nodes.estimate - LN2 - nodes.weighted)[at]
                mix += stop * (own - mix)
            if level.up is not None:
                entry = level.up[entry]
        yield j, np.where(one, mix, 1 - mix)


def ranges_of(keys: np.ndarray) -> Iterator[slice]:
    """Sorted keys in pieces of about TREE keys that share no context of two bytes."""
    pair = keys >> np.uint64(8 * (DEPTH - 1))
    begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(keys) else np.zeros(0, np.int64)
    piece = begins // TREE
    begins = begins[np.r_[True, piece[1:] != piece[:-1]]] if len(begins) else begins
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
        yield slice(a, b)


def upper_sums(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each latest context byte and decision: zeros, ones, and the sum of the log weighted probabilities of depth 2."""
    out = np.zeros((3, 65536))
    for piece in ranges_of(keys):
        levels = levels_of(keys[piece], counts[piece], 2)
        for j in range(8):
            nodes = nodes_of(levels, j)[-1]
            code = levels[-1].codes[nodes.first]
            place = (((code >> np.uint64(16)) & np.uint64(255)) << np.uint64(8) | np.uint64(1 << j) | ((code & np.uint64(255)) >> np.uint64(8 - j))).astype(np.int64)
            for k, value in enumerate((nodes.zeros, nodes.ones, nodes.weighted)):
                out[k] += np.bincount(place, weights=value, minlength=65536)
    return out


def upper_mix(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 add to the probability of a one (and of a zero), and the weight they leave to deeper ones.

    Arrays of 256 latest bytes x 256 decisions (x 2 bits).
    """
    a, b, below = (x.reshape(256, 256) for x in sums)
    estimate = log_kt(a.astype(np.int64), b.astype(np.int64))
    weighted = np.logaddexp(estimate, below) - LN2
    stop = np.exp(estimate - LN2 - weighted)
    root_a, root_b = a.sum(axis=0), b.sum(axis=0)
    root = log_kt(root_a.astype(np.int64), root_b.astype(np.int64))
    root_stop = np.exp(root - LN2 - (np.logaddexp(root, weighted.sum(axis=0)) - LN2))
    known = np.stack([root_stop * (n + 0.5) / (root_a + root_b + 1) + (1 - root_stop) * stop * (m + 0.5) / (a + b + 1) for n, m in ((root_a, a), (root_b, b))], axis=2)
    return known, (1 - root_stop) * (1 - stop)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences, byte planes apart."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def packed_counts(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def packed_values(values: np.ndarray) -> bytes:
    """Floats by byte planes, after a byte that tells their size."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked_values(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<f{blob[0]}").ravel()


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block, doc_id and text as rows of block and rows: all of a block that a task holds, compressed."""
    held: list[pa.RecordBatch] = []

    def send() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        block = rows.column("block").to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cut.tolist(), np.r_[cut[1:], len(block)].tolist(), strict=True):
            own = rows.slice(a, b - a).select(["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    size = 0
    for batch in batches:
        for part in ta.blocks(iter([batch])):
            held.append(part)
            size += part.column("text").nbytes
            if size > PACKED:
                yield from send()
                held, size = [], 0
    if held:
        yield from send()


def texts_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The doc_id and text that packed_texts() packed."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")]
    at = np.cumsum([x.nbytes for x in parts]) // SLICE
    for piece in np.unique(at):
        yield from pa.concat_tables([x for x, k in zip(parts, at, strict=True) if k == piece]).combine_chunks().to_batches()


def unpacked(blob: bytes, gaps: bool = True) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if gaps else values.astype(np.int64)


@dataclass
class Stream:
    """The coded bytes of some texts: a key and the text's number for each; and hashes and text numbers of all tokens."""

    keys: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    word_doc: np.ndarray
    texts: int


def stream(texts: pa.Array) -> Stream:
    found = ta.tokens(texts)
    rows = len(found.doc_starts) - 1
    sizes = found.ends - found.starts
    n_tokens = np.diff(found.doc_starts)
    bytes_of = np.bincount(found.doc, weights=sizes + 1, minlength=rows).astype(np.int64)
    bytes_of[n_tokens == 0] = 1
    ends = np.cumsum(bytes_of + DEPTH)
    begins = ends - bytes_of - DEPTH
    line = np.full(int(ends[-1]) if rows else 0, 10, np.uint8)
    before = np.cumsum(sizes + 1) - (sizes + 1)
    start = before - before[found.doc_starts[found.doc]] + begins[found.doc] + DEPTH if len(sizes) else before
    steps = np.cumsum(sizes)
    inside = np.arange(steps[-1] if len(steps) else 0)
    line[np.repeat(start - (steps - sizes), sizes) + inside] = found.data[np.repeat(found.starts - (steps - sizes), sizes) + inside]
    last = np.zeros(len(sizes), bool)
    last[found.doc_starts[1:][n_tokens > 0] - 1] = True
    line[(start + sizes)[~last]] = 32
    doc = np.repeat(np.arange(rows), bytes_of)
    at = np.arange(len(doc)) + DEPTH * (doc + 1)
    wide = line.astype(np.uint64)
    keys = wide[at]
    for back in range(1, DEPTH + 1):
        keys |= wide[at - back] << np.uint64(8 * (DEPTH + 1 - back))
    words = np.r_[found.hashes(), np.full(rows, END, np.uint64)]
    return Stream(keys, doc, words, np.r_[found.doc, np.arange(rows)], rows)


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stream]]:
    for block in ta.blocks(batches, most=SLICE):
        for at in range(0, block.num_rows, MOST_TEXTS):
            part = block.slice(at, MOST_TEXTS)
            yield part, stream(part.column("text"))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    flat, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(n, first) if len(first) else n


def gathered(pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """merged() of many pieces, with no more held than about twice the distinct keys."""
    keys, counts, kept, size = [], [], 0, 0
    for k, c in pieces:
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size - kept > max(HELD // 2, kept):
            k, c = merged(keys, counts)
            keys, counts, kept, size = [k], [c], len(k), len(k)
    return merged(keys, counts)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def distinct(keys: list[np.ndarray]) -> np.ndarray:
    """Distinct keys, sorted."""
    flat = np.concatenate([np.zeros(0, np.uint64), *keys])
    keys.clear()
    flat.sort()
    return flat[np.r_[True, flat[1:] != flat[:-1]]] if len(flat) else flat


def buckets_of(keys: np.ndarray, kind: int, n: int) -> np.ndarray:
    """Contexts (kind 0) are dealt out by their two latest bytes to 0 ... n - 1, tokens (kind 1) to n ... 2 n - 1."""
    own = ta.mixed(keys >> np.uint64(8 * (DEPTH - 1))) if kind == 0 else keys
    return (own % np.uint64(n)).astype(np.int64) + n * kind


def dealt(keys: np.ndarray, kind: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and places of its keys, in order."""
    if not len(keys):
        return
    bucket = buckets_of(keys, kind, n)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for a, b in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _count(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []), ([], [])]
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in enumerate(held):
                keys_, counts_ = merged(keys, counts)
                rows = [(b, packed(keys_[at]), packed_counts(counts_[at])) for b, at in dealt(keys_, kind, n)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "counts"])

        for _, s in streams(batches):
            for (keys, counts), flat in zip(held, (s.keys, s.words), strict=True):
                k, c = counted(flat)
                keys.append(k)
                counts.append(c)
                size += len(k)
            if size > HELD:
                held = [tuple([x] for x in merged(*pair)) for pair in held]
                size = sum(len(pair[0][0]) for pair in held)
                if size > HELD // 2:
                    yield from send()
                    held, size = [([], []), ([], [])], 0
        yield from send()

    return work


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame, teaches: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes (coded) of every document.

    teaches: a condition on doc_id for training rows; all but the held-out ones unless given. score is in log10, so
    -score * log2(10) / n_bytes is the code length per byte.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, n_blocks = max(96, -(-total // PER_BUCKET)), max(1, -(-total // BLOCK))
    teaches = ~held_out(F.col("doc_id")) if teaches is None else teaches

    def sent(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, counts in zip(table.column("keys"), table.column("counts"), strict=True):
            yield unpacked(keys.as_py()), unpacked(counts.as_py(), False)

    def combine(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = gathered(sent(table))
        upper = zstandard.ZstdCompressor(level=1).compress(upper_sums(keys, counts).tobytes()) if bucket < n else b""
        words = bucket >= n
        return pa.table({"bucket": [bucket], "keys": [packed(keys)], "counts": [packed_counts(counts)], "upper": pa.array([upper], pa.binary()), "tokens": [int(counts.sum()) * words], "kinds": [len(keys) * words]})

    parts = rows.where(teaches).select("text").mapInArrow(_count(n), "bucket long, keys binary, counts binary")
    model = parts.groupBy("bucket").applyInArrow(combine, "bucket long, keys binary, counts binary, upper binary, tokens long, kinds long").checkpoint()
    release(docs.sparkSession)

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(3 * 65536)
        for blob in table.column("upper").to_pylist():
            sums += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // 16], pa.int64()), "upper": pa.array([zstandard.ZstdCompressor(level=1).compress(sums.tobytes())], pa.binary())})

    # at most 256 x 256 sums, whatever the corpus: added up in steps of 16
    upper = model.where(F.col("bucket") < n).select(F.col("bucket").alias("part"), "upper")
    width = n
    while width > 1:
        upper, width = upper.withColumn("part", F.floor(F.col("part") / 16) * 16).groupBy("part").applyInArrow(add, "part long, upper binary"), -(-width // 16)
    told = upper.first()
    sums = np.frombuffer(zstandard.ZstdDecompressor().decompress(told.upper)).reshape(3, -1) if told else np.zeros((3, 65536))
    known, rest = upper_mix(sums)
    told = model.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    train_tokens, kinds = int(told.n or 0), int(told.v or 0)

    by_block = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "doc_id", "text").mapInArrow(packed_texts, "block long, rows binary").groupBy("block")

    def own_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[np.ndarray]] = [[], []]
        size = [0, 0]
        for _, s in streams(texts_of(table)):
            for kind, flat in enumerate((s.keys, s.words)):
                found[kind].append(counted(flat)[0])
                size[kind] += len(found[kind][-1])
                if size[kind] > HELD // 2:
                    found[kind] = [distinct(found[kind])]
                    size[kind] = 0
        return distinct(found[0]), distinct(found[1])

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        asked = [(b, packed(keys[at])) for kind, keys in enumerate(own_keys(table)) for b, at in dealt(keys, kind, n)]
        return pa.table({"block": pa.array([block] * len(asked), pa.int64()), "bucket": pa.array([x[0] for x in asked], pa.int64()), "asked": pa.array([x[1] for x in asked], pa.binary())})

    def answer(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "asked": pa.array([], pa.binary()), "answers": pa.array([], pa.binary())})
        bucket = asked.column("bucket")[0].as_py()
        wanted = (unpacked(x.as_py()) for x in asked.column("asked"))
        keys, counts = gathered(chain(sent(model), ((x, np.zeros(len(x), np.int64)) for x in wanted)))
        if bucket < n:
            value = np.zeros(len(keys), "<f4")
            for piece in ranges_of(keys):
                part = keys[piece]
                latest, byte = ((part >> np.uint64(8 * DEPTH)) & np.uint64(255)).astype(np.int64), (part & np.uint64(255)).astype(np.int64)
                own = np.zeros(len(part))
                for j, deep in bits_given(levels_of(part, counts[piece], 2)):
                    decision, bit = 1 << j | byte >> (8 - j), byte >> (7 - j) & 1
                    own += np.log10(known[latest, decision, bit] + rest[latest, decision] * deep)
                value[piece] = own
        else:
            value = counts.astype("<f4") if counts.max(initial=0) < 2**24 else counts.astype("<f8")
        out = [packed_values(value[np.searchsorted(keys, unpacked(x.as_py()))]) for x in asked.column("asked")]
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "asked": asked.column("asked"), "answers": pa.array(out, pa.binary())})

    def add_up(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, values = [], []
        bucket = answers.column("bucket").to_numpy()
        for kind in (0, 1):
            own = answers.filter(pa.array((bucket >= n) == kind))
            flat = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x) for x in own.column("asked").to_pylist())])
            value = np.concatenate([np.zeros(0, np.float32), *(unpacked_values(x) for x in own.column("answers").to_pylist())])
            order = np.argsort(flat)
            keys.append(flat[order])
            values.append(value[order])
        out = []
        for part, s in streams(texts_of(texts)):
            order = np.argsort(s.keys)
            key_, doc = s.keys[order], s.doc[order]
            first = np.flatnonzero(np.r_[True, key_[1:] != key_[:-1]]) if len(key_) else doc
            value = np.repeat(values[0][np.searchsorted(keys[0], key_[first])], np.diff(np.r_[first, len(key_)]))
            score = np.bincount(doc, weights=value, minlength=s.texts)
            count = values[1][np.searchsorted(keys[1], s.words)]
            n_tokens = np.bincount(s.word_doc, minlength=s.texts)
            base = np.bincount(s.word_doc, weights=np.log10(count + 1), minlength=s.texts) - n_tokens * math.log10(train_tokens + kinds + 1)
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "n_tokens": n_tokens, "n_known": np.bincount(s.word_doc[count > 0], minlength=s.texts), "train_tokens": np.full(s.texts, train_tokens), "base_score": base, "score": score,
                "n_bytes": np.bincount(s.doc, minlength=s.texts),
            }))
        return pa.concat_tables(out)

    asked = by_block.applyInArrow(ask, "block long, bucket long, asked binary")
    replies = asked.groupBy("bucket").cogroup(model.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(answer, "block long, bucket long, asked binary, answers binary")
    scored = by_block.cogroup(replies.groupBy("block")).applyInArrow(add_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
