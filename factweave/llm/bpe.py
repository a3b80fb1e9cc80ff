"""BPE encoding and decoding by batched merge rounds over one flat array of symbols.

The words of a block are told apart once; the symbols of all words not met before lie end to end in one array. A round
looks every adjacent pair up in the sorted pair keys by binary search, takes the lowest rank of each piece, and merges
that pair wherever it stands in its piece. A merge only makes pairs of higher rank, so this equals merging one by one.

Edge cases. A null or empty text has no ids and decodes to an empty text. Texts of any length are encoded whole; a very
long one is a block of its own. Repeated rows and ties are encoded alike. Tables without rows give no rows. Other
columns pass through; `ids` and `n_tokens` of an input are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import textarrays as ta

#: Words remembered between the blocks of a task.
MOST_WORDS = 400_000
#: The rank of a pair that is never merged.
LAST = np.iinfo(np.int64).max


#: Code points that `regex` takes for letters and for numbers, and the tokenizers library doesn't.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Capital letters that Python doesn't lower and the library does: first, last, and how far their small letters are.
LATER_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
LOWERED = {c: c + apart for first, last, apart in LATER_CAPITALS for c in range(first, last + 1)}


def class_of(ranges: str) -> str:
    """What stands in the brackets of a regex class of these code points."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in ranges.split())


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1 ... of every span, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """A vocabulary file whose words end in a suffix: ranked pairs, byte symbols, pre-tokenizer and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + self.suffix] for b in range(256)], np.int64)
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters, numbers = class_of(LATER_LETTERS), class_of(LATER_NUMBERS)
        careful = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]").replace(r"[\p{L}]", rf"[\p{{L}}--[{letters}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{numbers}]]")
        self.usual, self.careful = regex.compile(f"\\n|{pattern}"), regex.compile(f"(?V1)\\n|{careful}")
        self.later = regex.compile(f"[{letters}{numbers}{''.join(map(chr, LOWERED))}]")
        names = {i: t for t, i in (vocab | self.added).items()}
        strings = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.string_sizes = np.array([len(x) for x in strings], np.int64)
        self.string_starts = np.cumsum(self.string_sizes) - self.string_sizes
        self.string_bytes = np.frombuffer(b"".join(strings), np.uint8)

    def pieces(self, text: str) -> list[bytes]:
        """The pieces of a text in normal form, and its line ends.

        Each letter is lowered on its own: a capital sigma at a word's end becomes the plain one.
        """
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.later.search(text):
            return list(map(str.encode, self.usual.findall(text)))
        return list(map(str.encode, self.careful.findall(text.translate(LOWERED))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; LAST if it has none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], LAST)

    def merged(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the piece of each. piece: ascending numbers."""
        done_symbols, done_piece = [symbols[:0]], [piece[:0]]
        rank = np.full(len(symbols), LAST)  # of the pair that a symbol makes with the next one
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            stays = lowest < LAST
            done_symbols.append(symbols[~stays])
            done_piece.append(piece[~stays])
            hit = (rank == lowest) & stays
            # in a run of equal symbols every second pair is merged, from the left
            run_start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            index = np.flatnonzero(hit)
            run = np.searchsorted(run_start, index, side="right") - 1
            index = index[(index - run_start[run]) % 2 == 0]
            symbols[index] = self.made[rank[index]]
            stays[index + 1] = False
            here = (np.cumsum(stays) - 1)[index]
            symbols, piece, rank = symbols[stays], piece[stays], rank[stays]
            for at in (here, here - 1):
                at = at[at >= 0]
                after = np.minimum(at + 1, len(symbols) - 1)
                rank[at] = np.where((piece[after] == piece[at]) & (after > at), self.ranks(symbols[at], symbols[after]), LAST)
        symbols, piece = np.concatenate(done_symbols), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return symbols[order], piece[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of each word's ids."""
        plain = [b"" if b"<|" in word else word for word in words]
        flat = self.pieces(b"\n".join(plain).decode("utf-8", "replace"))
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        data = np.frombuffer(b"".join(flat), np.uint8)
        starts = np.cumsum(sizes) - sizes
        ends_word = data[starts] == 10
        owner, data = np.cumsum(ends_word)[~ends_word], data[np.repeat(~ends_word, sizes)]
        sizes = sizes[~ends_word]
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        symbols, piece = self.merged(symbols, np.repeat(np.arange(len(sizes)), sizes))
        counts = np.bincount(owner[piece], minlength=len(words))
        marked = [k for k, word in enumerate(words) if b"<|" in word]
        if marked:
            parts = dict(zip(marked, map(self.encode_marked, [words[k] for k in marked]), strict=True))
            rows = np.split(symbols, np.cumsum(counts)[:-1])
            rows = [parts.get(k, row) for k, row in enumerate(rows)]
            symbols, counts = np.concatenate(rows), np.array([len(x) for x in rows])
        return symbols.astype(np.uint32), counts

    def encode_marked(self, word: bytes) -> np.ndarray:
        """Ids of a word that may hold added tokens."""
        out = [np.zeros(0, np.int64)]
        for part in self.added_split.split(word.decode("utf-8", "replace")):
            if part in self.added:
                out.append(np.array([self.added[part]]))
            elif part:
                pieces = self.pieces(part)
                data = np.frombuffer(b"".join(pieces), np.uint8)
                sizes = np.array([len(x) for x in pieces], np.int64)
                symbols = self.inner[data]
                last = np.cumsum(sizes) - 1
                symbols[last] = self.final[data[last]]
                out.append(self.merged(symbols, np.repeat(np.arange(len(sizes)), sizes))[0])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts that the ids in ids[offsets[i]:offsets[i + 1]] stand for, and offsets into them."""
        sizes = self.string_sizes[ids]
        keep = spans(self.string_starts[ids], sizes)
        ends = np.r_[0, np.cumsum(sizes)][offsets]
        data = self.string_bytes[keep]
        counts = np.maximum(np.diff(ends) - 1, 0)  # no blank after the last token
        return data[spans(ends[:-1], counts)], np.r_[0, np.cumsum(counts)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes blocks of texts, remembering words."""

    def __init__(self, path: str):
        self.words, self.known = vocabulary(path), {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len(texts) + 1 offsets into them."""
        raw, _ = ta.text_buffers(texts)
        found = ta.tokens(texts)
        sizes = found.ends - found.starts
        _, first, place = np.unique(ta.span_hashes(raw, found.starts, found.ends), return_index=True, return_inverse=True)
        # words of one hash are one word only if their bytes agree
        other = np.flatnonzero(sizes != sizes[first[place]])
        alike = np.flatnonzero(sizes == sizes[first[place]])
        other = np.union1d(other, alike[~ta.equal_spans(raw, found.starts[alike], found.starts[first[place[alike]]], sizes[alike])])
        place[other] = len(first) + np.arange(len(other))
        first = np.r_[first, other]
        if len(self.known) > MOST_WORDS:
            self.known = {}
        whole = raw.tobytes()
        words = [whole[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
        fresh = list({word for word in words if word not in self.known})
        if fresh:
            ids, counts = self.words.encode_words(fresh)
            stops = np.cumsum(counts).tolist()
            self.known |= zip(fresh, [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True)
        own = [self.known[word] for word in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.concatenate(own) if own else np.zeros(0, np.uint32)
        starts = np.cumsum(sizes) - sizes
        ids = flat[spans(starts[place], sizes[place])]
        return ids, np.r_[0, np.cumsum(sizes[place])][found.doc_starts]


def _text_first(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("string"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """All columns, `ids` (array<int>) and `n_tokens`."""
    docs = _text_first(docs.drop("ids", "n_tokens"))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for block in ta.blocks(batches):
            ids, offsets = encoder.encode(block.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns, rows, pa.array(np.diff(offsets), pa.int64())], [*block.schema.names, "ids", "n_tokens"])

    return docs.mapInArrow(work, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """The columns of encoded(), with `text` made from `ids` alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column("ids")
                counts = np.array([len(x) if x is not None else 0 for x in rows.to_pylist()], np.int64)
                data, offsets = words.decode(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(counts)])
                text = pa.array([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
                yield part.set_column(part.schema.get_field_index("text"), "text", text)

    return tokens.mapInArrow(work, tokens.schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for block in ta.blocks(batches):
            ids, offsets = encoder.encode(block.column("text"))
            data, bounds = encoder.words.decode(ids, offsets)
            sums = [
                [hashlib.sha256(memoryview(flat[a:b])).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for flat, at in ((np.ascontiguousarray(ids, "<u4"), offsets), (data, bounds))
            ]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _text_first(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)
