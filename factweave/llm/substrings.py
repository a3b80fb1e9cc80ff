"""Repeated substrings by longest-previous-factor arrays over suffix order.

Two equal stretches of LENGTH bytes have the same smallest GRAM-byte hash at the same place in them: their anchor. So
the windows of all texts are dealt out by anchor. Anchors that stand once go first; for the others the runs of windows
around them are sent, equal runs of a block of documents once. In a task, the windows that hold their anchor at one
offset are suffixes cut at LENGTH; in their sorted order the previous and the next smaller text position give each
window's longest previous factor, which is LENGTH if an equal window stands earlier. Each document then unites the
windows found.

Edge cases. A null text is empty; texts shorter than LENGTH have no windows, and windows never cross texts. A text of any
length is one row of one block. Repeated rows are copies of each other, so their windows are found. A null doc_id is
kept. Empty tables give no rows. Extra columns are ignored by repeated_spans() and pass through keep_first_copies().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta

GRAM = 32
#: Bytes of text that form a block of documents.
BLOCK = 6_000_000
#: Bytes of text worked on at once.
SLICE = 600_000
#: Runs sorted at once; those of a hot anchor are sorted together.
ROWS = 4_000


def suffix_order(windows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings (rows); equal ones by position."""
    wide = np.ascontiguousarray(windows)
    return np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="stable")


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before it and after it with a smaller text position (-1, n: none)."""
    n = len(position)
    held = np.r_[position, -1]
    before, after = np.arange(n) - 1, np.arange(n) + 1
    for near in (before, after):  # both ends, -1 and n, find the -1 at the end of held
        late = np.flatnonzero(held[near] > position)
        while len(late):
            near[late] = near[near[late]]
            late = late[held[near[late]] > position[late]]
    return before, after


def previous_factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the length of its longest previous factor (the longest prefix that begins an earlier row, too), and such a row (-1: none)."""
    order = suffix_order(windows)
    before, after = smaller_neighbours(order)
    factor, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for near, none in ((before, -1), (after, len(order))):
        at = np.flatnonzero(near != none)
        differs = windows[order[at]] != windows[order[near[at]]]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), windows.shape[1])
        longer = common > factor[order[at]]
        factor[order[at[longer]]], source[order[at[longer]]] = common[longer], order[near[at[longer]]]
    return factor, source


def runs(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes, offsets, and for each run of windows with one anchor: begin and stop (of the bytes it spans), anchor (place), doc and gram (hash)."""
    data, offsets = ta.text_buffers(texts)
    reach = length - GRAM + 1
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < reach:
        return data, offsets, {k: none for k in ("begin", "stop", "anchor", "doc")} | {"gram": none.astype(np.uint64)}
    gram = gram_hashes(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = gram & ~low
    key |= np.arange(n, dtype=np.uint64)  # of equal grams the first counts
    span, least = 1, key
    while span * 2 <= reach:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: n - reach + 1], least[reach - span : n - span + 1])
    # a run begins where the anchor changes and where a text begins; its last window is the text's last one at most
    begin = np.unique(np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1, offsets[:-1][offsets[:-1] < len(least)]])
    doc = np.searchsorted(offsets, begin, side="right") - 1
    last = np.minimum(np.r_[begin[1:], len(least)] - 1, offsets[doc + 1] - length)
    fine = last >= begin
    begin, last, doc = begin[fine], last[fine], doc[fine]
    anchor = (least[begin] & low).astype(np.int64)
    return data, offsets, {"begin": begin, "stop": last + length, "anchor": anchor, "doc": doc, "gram": ta.mixed(gram[anchor])}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, doubled up from single bytes."""
    out, span, factor = ta.BYTE_CODE[data], 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        out = out[:-span] * np.uint64(factor) + out[span:]
        factor, span = factor * factor % 2**64, span * 2
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def run_names(raw: memoryview, found: dict[str, np.ndarray], ids: np.ndarray | None, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit name of each run's bytes and of its anchor's place in them; with the texts' ids, of its own place, too."""
    digest = xxhash.xxh3_128_digest
    own = found["anchor"] - found["begin"]
    if ids is None:
        return [digest(raw[a:b], seed=k) for a, b, k in zip(found["begin"].tolist(), found["stop"].tolist(), own.tolist(), strict=True)]
    place = found["begin"] - offsets[found["doc"]]
    return [digest(b"%d %d " % (d, p) + raw[a:b], seed=k) for a, b, k, d, p in zip(found["begin"].tolist(), found["stop"].tolist(), own.tolist(), ids[found["doc"]].tolist(), place.tolist(), strict=True)]


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return ta.blocks(table.combine_chunks().to_batches(), most=SLICE)


def matched_windows(gram: np.ndarray, before: np.ndarray, text: list[bytes], length: int, first_too: bool) -> np.ndarray:
    """Bits [run, offset]: whether the window that begins `offset` bytes before the anchor stands earlier (or, with first_too, anywhere else) among the runs."""
    most = length - GRAM
    sizes = np.array([len(x) for x in text])
    board = np.zeros((len(text), most + length), np.uint8)
    for k, (x, b) in enumerate(zip(text, before.tolist(), strict=True)):
        board[k, most - b : most - b + len(x)] = np.frombuffer(x, np.uint8)
    names = gram.astype(">i8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(text), most + 1), bool)
    for offset in range(most + 1):
        rows = np.flatnonzero((before >= offset) & (before - offset + length <= sizes))
        if len(rows) > 1:
            factor, source = previous_factors(np.concatenate([names[rows], board[rows, most - offset : most - offset + length]], axis=1))
            whole = factor == 8 + length
            out[rows[whole], offset] = True
            if first_too:
                out[rows[source[whole]], offset] = True
    return out


def spans_of(mask: np.ndarray) -> np.ndarray:
    """Begin and stop of every stretch of true bytes."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return edge.reshape(-1, 2)


def covered(docs: DataFrame, finish: Callable[[bytes, list[int]], tuple], schema: str, length: int = 200, first_too: bool = True) -> DataFrame:
    """doc_id and finish(bytes of the text, spans) of every document. Spans: begin, stop, begin, stop ... of all bytes in windows that stand elsewhere, too.

    With first_too=False the first copy of a window is left out. finish runs in the task that has the spans, so texts leave
    it once, as what finish makes of them; schema names its columns.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    def anchors(table: pa.Table) -> pa.Table:
        grams = [np.zeros(0, np.uint64)]
        for part in sliced(table):
            grams.append(runs(part.column("text"), length)[2]["gram"])
        gram, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.table({"block": pa.array(np.full(len(gram), table.column("block")[0].as_py()), pa.int64()), "gram": gram.view(np.int64), "n": n})

    def send(key: tuple, texts: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.sort(shared.column("gram").to_numpy()).view(np.int64)
        out = {k: [] for k in ("gram", "name", "before", "run", "n", "doc", "begin")}
        seen: dict[bytes, int] = {}
        for part in sliced(texts):
            data, offsets, found = runs(part.column("text"), length)
            ids = ids_of(part)
            own = found["gram"].view(np.int64)
            at = np.minimum(np.searchsorted(wanted, own), max(len(wanted) - 1, 0))
            keep = np.flatnonzero(wanted[at] == own) if len(wanted) else np.zeros(0, np.int64)
            found = {k: v[keep] for k, v in found.items()}
            raw = data.tobytes()
            names = run_names(memoryview(raw), found, None if first_too else ids, offsets)
            for name, gram, begin, stop, anchor, doc, at in zip(names, found["gram"].view(np.int64).tolist(), *(found[k].tolist() for k in ("begin", "stop", "anchor")), ids[found["doc"]].tolist(), (found["begin"] - offsets[found["doc"]]).tolist(), strict=True):
                if name in seen:
                    out["n"][seen[name]] += 1
                else:
                    seen[name] = len(out["n"])
                    for k, v in (("gram", gram), ("name", name), ("before", anchor - begin), ("run", raw[begin:stop]), ("n", 1), ("doc", doc), ("begin", at)):
                        out[k].append(v)
        block = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        return pa.table({"block": pa.array([block] * len(out["n"]), pa.int64()), "gram": pa.array(out["gram"], pa.int64()), "name": pa.array(out["name"], pa.binary()), "before": pa.array(out["before"], pa.int32()), "run": pa.array(out["run"], pa.binary()), "n": pa.array(out["n"], pa.int32()), "doc": pa.array(out["doc"], pa.int64()), "begin": pa.array(out["begin"], pa.int64())})

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            # runs of several blocks that are equal are one run, whose windows all stand elsewhere
            name = np.array(table.column("name").to_pylist(), "V16")
            first = place = np.arange(len(name))
            if first_too:
                _, first, place, times = np.unique(name.view("u8,u8"), return_index=True, return_inverse=True, return_counts=True)
            before = table.column("before").to_numpy().astype(np.int64)
            text = table.column("run").to_pylist()
            some = matched_windows(table.column("gram").to_numpy()[first], before[first], [text[k] for k in first.tolist()], length, first_too)
            bits = some[place]
            if first_too:
                bits[(times[place] > 1) | (table.column("n").to_numpy() > 1)] = True
            keep = bits.any(axis=1)
            packed = [x.tobytes() for x in np.packbits(bits[keep], axis=1)]
            return pa.RecordBatch.from_arrays([table.column(k).combine_chunks().filter(pa.array(keep)) for k in ("block", "name")] + [pa.array(packed, pa.binary())], ["block", "name", "bits"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if len(table) >= ROWS:
                gram = table.column("gram").to_numpy()
                last = int(np.searchsorted(gram, gram[-1]))
                if last:
                    yield solved(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    def unite(key: tuple, texts: pa.Table, solved: pa.Table) -> pa.Table:
        place = {name: k for k, name in enumerate(solved.column("name").to_pylist())}
        bits = np.frombuffer(b"".join(solved.column("bits").to_pylist()), np.uint8).reshape(len(place), -1) if place else np.zeros((0, 1), np.uint8)
        out = []
        for part in sliced(texts):
            data, offsets, found = runs(part.column("text"), length)
            raw = memoryview(data.tobytes())
            at = np.array([place.get(name, -1) for name in run_names(raw, found, None if first_too else ids_of(part), offsets)], np.int64)
            hit = np.flatnonzero(at >= 0)
            run, offset = np.nonzero(np.unpackbits(bits[at[hit]], axis=1))
            anchor, begin, stop = found["anchor"][hit[run]], found["begin"][hit[run]], found["stop"][hit[run]]
            start = anchor - offset
            start = start[(start >= begin) & (start + length <= stop)]
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + length, -1)
            mask = np.cumsum(depth[:-1]) > 0
            for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append((doc, *finish(bytes(raw[a:b]), spans_of(mask[a:b]).ravel().tolist())))
        types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * (1 + len(types))
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *types], strict=True)], names=["doc_id", *(x.split()[0] for x in schema.split(", "))])

    by_block = rows.groupBy("block")
    grams = by_block.applyInArrow(anchors, "block long, gram long, n long")
    shared = grams.withColumn("all", F.sum("n").over(Window.partitionBy("gram"))).where(F.col("all") > 1).select("block", "gram")
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, "block long, gram long, name binary, before int, run binary, n int, doc long, begin long")
    solved = sent.repartition("gram").sortWithinPartitions("gram", "doc", "begin").mapInArrow(resolve, "block long, name binary, bits binary")
    return by_block.cogroup(solved.groupBy("block")).applyInArrow(unite, f"doc_id long, {schema}")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256: every byte in a stretch of `length` bytes that starts anywhere else is removed."""

    def finish(raw: bytes, spans: list[int]) -> tuple:
        return len(raw), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, hashlib.sha256(without(raw, spans)).hexdigest()

    return covered(docs, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def without(raw: bytes, spans: list[int]) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def keep_first_copies(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id and text without the later copies of stretches of `length` bytes; the first copy of each, by doc_id and place, stays."""
    return covered(docs, lambda raw, spans: (without(raw, spans).decode(errors="ignore"),), "text string", length, first_too=False)
