"""Near-duplicate documents by SimHash fingerprints and a self-join of their binary trie.

A text's words, A-Z in lower case, give three-word shingles, repeats included; a bit of its 64-bit fingerprint is set where
more than half of the shingles' XXH64 values have it. Different fingerprints are the leaves of a binary trie, read from the
highest bit. Pairs of trie nodes go down together, from the root with itself, and carry how many bits they differ in; a pair
that differs in more than the budget is dropped with everything below it. The upper levels go down as rounds of joins, two
bits a round, on nodes and their numbers of leaves; a pair of nodes whose leaves fit a task is handed to one, each node as one
packed row, and goes on bit by bit with flat arrays. Of the links a task finds it keeps a spanning forest, and components
join the forests.

No group is unbounded: equal fingerprints are one leaf, a node with many leaves is cut further, and no node lower than the
first 48 bits has more leaves than a task takes. A node at depth d is sent once for each node within the budget of it,
d * d * d / 6 or so of them, so larger nodes (`most`) send less: eight bytes a leaf each time.

Edge cases. A null text is empty; texts without words have fingerprint 0 and link like any others. A text of one or two
words is one shingle. A null doc_id takes part in links, but is nobody's smallest id: its component may be null. Repeated
rows are rows of their own with one component. Empty tables give no rows. Extra columns are ignored. Texts of any length are
read whole, their shingles counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factweave.llm import textarrays as ta
from factweave.llm.components import stars
from factweave.llm.shared import stored

WIDTH, SEED = 3, 42
#: Bits of a fingerprint, and bits that a round of joins goes down.
BITS, STRIDE = 64, 2
#: Leaves of both nodes of a pair together that a task takes.
LEAVES = 1 << 16
#: Pairs of leaves below which a task compares them without going further down; pairs of nodes that it holds at once.
FEW, AT_ONCE = 256, 4096
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprints_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text."""
    found = ta.tokens(texts)
    n = np.diff(found.doc_starts)
    # words with one space after each, end to end
    sizes = found.ends - found.starts
    at = np.r_[0, np.cumsum(sizes + 1)]
    joined = np.full(int(at[-1]), 32, np.uint8)
    inside = ~ta.SPACE[found.data]
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = found.data[inside]
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    first = np.repeat(found.doc_starts[:-1] - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(int(runs.sum()))
    last = np.minimum(first + width, np.repeat(found.doc_starts[1:], runs))
    begin, stop, whole = at[first], at[last] - 1, joined.tobytes()
    doc = np.repeat(np.arange(len(n)), runs)
    ones = np.zeros((len(n), BITS), np.int64)
    for k in range(0, len(doc), PIECE):
        hashes = np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begin[k : k + PIECE].tolist(), stop[k : k + PIECE].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[k : k + PIECE]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ones[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    most = (2 * ones > runs[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and bits (the fingerprint as a long) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fingerprints_of(block.column("text")).view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, bits long")


def trie_nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """node (the first `depth` bits), up (its node a stride above) and n (leaves below) of the trie."""
    node = F.shiftrightunsigned("bits", BITS - depth)
    return leaves.groupBy(node.alias("node")).agg(F.count("*").alias("n")).withColumn("up", F.shiftrightunsigned("node", STRIDE))


def task_pairs(leaves: DataFrame, budget: int, most: int) -> list[tuple[int, DataFrame]]:
    """For each depth: a, b (a <= b) and errors of the pairs of nodes that are handed to tasks."""
    pairs = leaves.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("errors"), (2 * F.col("n")).alias("n"))
    depth, found = 0, []
    while True:
        pairs = stored(pairs)
        ready = pairs.where(F.col("n") <= most)
        found.append((depth, ready.drop("n")))
        pairs = pairs.where(F.col("n") > most).drop("n")
        if pairs.isEmpty():
            return found
        depth += STRIDE
        nodes = trie_nodes(leaves, depth)
        left = nodes.select(F.col("node").alias("child_a"), F.col("up").alias("a"), F.col("n").alias("n_a"))
        right = nodes.select(F.col("node").alias("child_b"), F.col("up").alias("b"), F.col("n").alias("n_b"))
        met = pairs.join(left, "a").join(right, "b").where("child_a <= child_b")
        met = met.withColumn("errors", F.col("errors") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND((1 << STRIDE) - 1)))
        pairs = met.where(F.col("errors") <= budget).select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), "errors", (F.col("n_a") + F.col("n_b")).alias("n"))


def halves(leaves: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where each node's leaves, a stretch of the sorted leaves, go over to those with the bit set."""
    prefix = leaves[low] >> np.uint64(bit + 1) << np.uint64(bit + 1)
    return np.clip(np.searchsorted(leaves, prefix | np.uint64(1 << bit)), low, high)


def spread_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves of pairs of stretches."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    wide = np.repeat(wide, count)
    return np.repeat(a0, count) + step // wide, np.repeat(b0, count) + step % wide


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a - b; a label is the smallest place of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the leaves of two nodes (of one, if right is None). Leaves are sorted, uint64."""
    leaves = left if right is None else np.concatenate([left, right])
    label = np.arange(len(leaves))
    zero, n = np.zeros(1, np.int64), len(left)
    other = (zero, zero + n) if right is None else (zero, zero + len(right))
    partner, shift = (left, 0) if right is None else (right, n)
    stack = [(BITS - depth, zero, zero + n, *other, zero + errors)]
    while stack:
        bits, a0, a1, b0, b1, e = stack.pop()
        few = ((a1 - a0) * (b1 - b0) <= FEW) | (bits == 0)
        if few.any():
            i, j = spread_pairs(a0[few], a1[few], b0[few], b1[few])
            close = np.bitwise_count(left[i] ^ partner[j]) <= budget
            label = merged(label, i[close], j[close] + shift)
        if few.all():
            continue
        a0, a1, b0, b1, e = (x[~few] for x in (a0, a1, b0, b1, e))
        bit = bits - 1
        am, bm = halves(left, a0, a1, bit), halves(partner, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1) & (right is None)
        parts = [(a0, am, b0, bm, e, None), (am, a1, bm, b1, e, None), (a0, am, bm, b1, e + 1, None), (am, a1, b0, bm, e + 1, ~same)]
        kept = []
        for p0, p1, q0, q1, wrong, only in parts:
            live = (p0 < p1) & (q0 < q1) & (wrong <= budget)
            live = live if only is None else live & only
            kept.append([x[live] for x in (p0, p1, q0, q1, wrong)])
        whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
        stack += [(bit, *(x[k : k + AT_ONCE] for x in whole)) for k in range(0, len(whole[0]), AT_ONCE)]
    apart = np.flatnonzero(label != np.arange(len(leaves)))
    return leaves[apart], leaves[label[apart]]


def links(leaves: DataFrame, budget: int, most: int) -> DataFrame:
    """u, v: a spanning forest of the links among the leaves."""
    out = None
    for depth, pairs in task_pairs(leaves, budget, most):
        node = F.shiftrightunsigned("bits", BITS - depth) if depth else F.lit(0).cast("long")
        sides = pairs.select("a", "b", "errors", F.col("a").alias("node"), F.lit(False).alias("right")).unionByName(pairs.where("a <> b").select("a", "b", "errors", F.col("b").alias("node"), F.lit(True).alias("right")))
        packed = leaves.withColumn("node", node).join(sides.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("bits").alias("bits"))
        rows = sides.join(packed, "node").select(F.lit(depth).alias("depth"), "a", "b", "errors", "right", "bits")
        out = rows if out is None else out.unionByName(rows)

    def work(table: pa.Table) -> pa.Table:
        depth, errors = table.column("depth")[0].as_py(), table.column("errors")[0].as_py()
        sides = {right: np.sort(bits.values.to_numpy().view(np.uint64)) for right, bits in zip(table.column("right").to_pylist(), table.column("bits"), strict=True)}
        u, v = forest(sides[False], sides.get(True), depth, errors, budget)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return out.groupBy("depth", "a", "b").applyInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = 3, most: int = LEAVES) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of every document.

    Fingerprints that differ in `budget` bits or fewer are linked. most: leaves that a task takes.
    """
    signed = stored(fingerprints(docs))
    leaves = stored(signed.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    roots = stars(links(leaves.select("bits"), budget, most)).select(F.col("node").alias("bits"), "root")
    leaves = leaves.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    final = leaves.select("bits", "root").join(leaves.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    out = signed.join(final.select("bits", "component_id"), "bits", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
