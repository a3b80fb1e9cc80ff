"""Each operator against a plain version on small tables, and its edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from factweave.llm import bpe, chat, ctw, decontaminate, linededup, maintext, minhash, quality, substrings, topk

WORDS = "the of and river stone light under over seven apple green window carry bright".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [sentence(rng, rng.randrange(1, 60)) for _ in range(40)]
    out += [out[0], out[1], out[1], None, "", "   ", "a", "A B", out[2] + " tail", out[3].replace("the", "thee", 1), "x" * 3000, "Ünï çödé\ttext\nnew  line"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With a null id, a repeated row and columns whose names clash with results."""
    rows = [(k, t, "en", k, 7, 1.0) for k, t in enumerate(texts)] + [(None, "no id here at all", "en", 0, 0, 0.0), (3, texts[3], "en", 3, 7, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, block long, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_ctw(train, scored):
    """Weighted probabilities by recursion over all contexts."""
    def coded(text):
        return (b"\n" * ctw.DEPTH, " ".join(tokens(text)).encode() + b"\n")

    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text in train:
        pad, data = coded(text)
        line = pad + data
        for at in range(len(pad), len(line)):
            for j in range(8):
                head, bit = line[at] >> (8 - j), line[at] >> (7 - j) & 1
                for d in range(ctw.DEPTH + 1):
                    counts[line[at - d : at], j, head][bit] += 1
                    if d:
                        children[line[at - d + 1 : at], j, head].add(line[at - d : at])

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    known = {}

    def weighted(context, j, head):
        key = context, j, head
        if key not in counts:
            return 0.0
        if key not in known:
            own = kt(*counts[key])
            known[key] = own if len(context) == ctw.DEPTH else np.logaddexp(own, sum(weighted(c, j, head) for c in children[key])) - math.log(2)
        return known[key]

    def chance(line, at, d, j):
        head, bit = line[at] >> (8 - j), line[at] >> (7 - j) & 1
        key = line[at - d : at], j, head
        if key not in counts:
            return 0.5
        a, b = counts[key]
        own = ((a, b)[bit] + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return own
        stop = math.exp(kt(a, b) - math.log(2) - weighted(*key))
        return stop * own + (1 - stop) * chance(line, at, d + 1, j)

    out = []
    for text in scored:
        pad, data = coded(text)
        line = pad + data
        out.append(sum(math.log10(chance(line, at, 0, j)) for at in range(len(pad), len(line)) for j in range(8)))
    return out


def test_context_tree(docs, texts, none):
    got = ctw.scores(docs).toPandas()
    rows = [(None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r) for r in got.itertuples()]
    source = [(k, t) for k, t in enumerate(texts)] + [(None, "no id here at all"), (3, texts[3])]
    train = [t for k, t in source if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*tokens(t), None])
    total, kinds = sum(counts.values()), len(counts)
    expected = dict(zip([k for k, _ in source], plain_ctw(train, [t for _, t in source]), strict=True))
    assert len(rows) == len(source)
    for k, r in rows:
        words = [*tokens("no id here at all" if k is None else texts[k]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words))
        assert r.score == pytest.approx(expected[k], rel=1e-4)
    assert ctw.scores(none).count() == 0


def test_estimates_of_many_and_few():
    a = np.array([[0, 1, 5000], [3, 4095, 10**6]])
    b = np.array([[0, 0, 4096], [7, 4096, 12]])
    expected = [[math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(*row, strict=True)] for row in zip(a.tolist(), b.tolist(), strict=True)]
    assert ctw.log_kt(a, b) == pytest.approx(np.array(expected), rel=1e-7)


def test_trees_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    line = rng.choice(np.frombuffer(b"aabc ", np.uint8), 20_000).astype(np.uint64)
    keys = line[ctw.DEPTH :].copy()
    for back in range(1, ctw.DEPTH + 1):
        keys |= line[ctw.DEPTH - back : -back] << np.uint64(8 * (ctw.DEPTH + 1 - back))
    keys, counts = ctw.counted(keys)
    whole = ctw.upper_sums(keys, counts)
    monkeypatch.setattr(ctw, "TREE", 50)
    assert len(list(ctw.ranges_of(keys))) > 3
    assert ctw.upper_sums(keys, counts) == pytest.approx(whole)


def test_packed_texts_keep_their_rows(monkeypatch):
    monkeypatch.setattr(ctw, "PACKED", 40)
    block, ids, texts = [0, 1, 0, 1, 1], [5, None, 7, 8, 9], ["a" * 30, "", "b", "\u00e9" * 30, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids, pa.int64()), pa.array(texts)], ["block", "doc_id", "text"])
    out = pa.Table.from_batches(list(ctw.packed_texts(iter([batch]))))
    for k in (0, 1):
        got = pa.Table.from_batches(list(ctw.texts_of(out.filter(pa.array([x == k for x in out.column("block").to_pylist()])))))
        own = [(i, t) for b, i, t in zip(block, ids, texts, strict=True) if b == k]
        assert sorted(zip(got.column("doc_id").to_pylist(), got.column("text").to_pylist(), strict=True), key=str) == sorted(own, key=str)


def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    words = item.split()
    words[7], words[19] = "changed", "also"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    more = spark.createDataFrame([(900, "before " + " ".join(words) + " after", "en", 0, 0, 0.0), (901, " ".join(words[:6]), "en", 0, 0, 0.0)], docs.schema)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs.unionByName(more), bench).collect()}
    assert set(found) == {(900, 1), (900, 4)}
    assert (found[900, 1].matched, found[900, 1].overlap, found[900, 1].doc_token, found[900, 1].item_token) == (28, 30, 1, 0)
    assert decontaminate.clean(docs.unionByName(more), bench).count() == docs.count() + 1
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain_overlaps(texts, items):
    """(text, item): matched, length, begin in the text, begin in the item; by all diagonals."""
    out = {}
    for d, k in ((d, k) for d in range(len(texts)) for k in range(len(items))):
        a, w = tokens(texts[d]), tokens(items[k])
        for begin in range(-len(w) + 1, len(a)):
            low, high = max(0, -begin), min(len(w), len(a) - begin)
            same = [a[begin + i] == w[i] for i in range(low, high)]
            if not any(all(same[p + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(len(same) - len(m) + 1)):
                continue
            sums = [0]
            for x in same:
                sums.append(sums[-1] + (1 if x else -2))
            gains = [x - min(sums[: i + 1]) for i, x in enumerate(sums)]
            right = gains.index(max(gains))
            left = sums[: right + 1].index(min(sums[: right + 1]))
            row = (sum(same[left:right]), right - left, begin + low + left, low + left)
            if row[0] >= min(decontaminate.MATCHED, max(decontaminate.SHORTEST, math.ceil(decontaminate.SHARE * len(w)))) and ((d, k) not in out or (-out[d, k][0], out[d, k][2]) > (-row[0], row[2])):
                out[d, k] = row
    return out


def test_overlaps_by_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 7)
    rng = random.Random(1)
    met = 0
    for trial in range(20):
        few = "a b c d e f g h i j k l m n o p".split()[: (1, 2, 4, 16)[trial % 4]]
        items = [" ".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(4)] + [None]
        texts = [None]
        for _ in range(8):
            words = [rng.choice(few) for _ in range(rng.randrange(60))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [x if rng.random() < 0.9 else "other" for x in rng.choice(items[:4]).split()]
            texts.append(" ".join(words))
        expected = plain_overlaps(texts, items)
        got = decontaminate.Benchmark(list(range(5)), items).pairs(pa.array(texts, pa.string()))
        assert {(r[0], r[1]): tuple(r[2:]) for r in got.tolist()} == expected
        met += len(expected)
    assert met > 50
    began = time.time()
    began = time.time()
    same_word = decontaminate.Benchmark([*range(19), None], ["x " * 200] * 20)
    assert same_word.pairs(pa.array(["x " * 30_000])).tolist() == [[0, k, 200, 200, 0, 0] for k in range(20)]
    nearly = decontaminate.Benchmark([1], ["x " * 199 + "y"])
    assert nearly.pairs(pa.array(["x " * 30_000])).tolist() == [[0, 0, 199, 199, 0, 0]]
    assert time.time() - began < 30
    assert decontaminate.Benchmark([1], ["x " * 1000]).pairs(pa.array(["x " * 50_000])).tolist() == [[0, 0, 1000, 1000, 0, 0]]
    assert time.time() - began < 60


def test_chat(spark):
    odd = r"a <|im_end|> b <\|im_start|> [INST] </s> \ <<SYS>> [\\/INST] end"
    rng = random.Random(3)
    rows = [(1, 0, "system", "be brief", 1), (1, 1, "user", odd, 1), (1, 2, "assistant", odd + "x", 1), (2, 0, "user", None, 1), (2, 0, "user", None, 1), (None, 0, "assistant", "só", 1), (4, 1, "assistant", "first", 1), (4, 2, "we ird\nrole", "", 1)]
    rows += [(3, t, "user" if t % 2 else "assistant", sentence(rng, rng.randrange(0, 80)), 1) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    windows = chat.windows(frame, budget=120, history=40)
    assert windows.where("n_tokens > 120 AND size(loss) > 1").count() == 0
    assert windows.where("conv_id = 3").count() > 3
    assert windows.where("conv_id = 3 AND repeated > 0").count() > 0
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role, text or "") for c, t, role, text, _ in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        target = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0
    assert odd not in windows.where("conv_id = 1").first().formatted


def test_repeated_substrings(docs, texts, none):
    n = 40
    source = [(k, t or "") for k, t in enumerate(texts)] + [(None, "no id here at all"), (3, texts[3])]
    seen = Counter(t.encode()[i : i + n] for _, t in source for i in range(len(t.encode()) - n + 1))
    expected = Counter()
    for k, t in source:
        raw = t.encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                mask[i : i + n] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        expected[k, len(raw), int(mask.sum()), len(substrings.spans_of(mask)), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_spans(docs, n).collect())
    assert got == expected
    assert substrings.repeated_spans(none, n).count() == 0


def test_first_copies_stay(spark):
    rng = random.Random(4)
    rows, seen = [], set()
    part = "".join(rng.choice("abcdefgh ") for _ in range(120))
    for k in range(25):
        rows.append((k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150))) + part[rng.randrange(20) :] * (rng.random() < 0.6) + "zx" * 60 * (k % 7 == 0)))
    got = {r.doc_id: r.text for r in substrings.keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    for k, t in rows:
        mask = [0] * len(t)
        for i in range(len(t) - 49):
            if t[i : i + 50] in seen:
                mask[i : i + 50] = [1] * 50
            seen.add(t[i : i + 50])
        assert got[k] == "".join(c for c, m in zip(t, mask, strict=True) if not m)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark, none):
    rng = random.Random(6)
    base = [sentence(rng, rng.randrange(3, 9)) for _ in range(25)]

    def changed(line):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(line))
            line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("xyz ") + line[i:], line[:i] + rng.choice("xyz ") + line[i + 1 :]])
        return line

    rows = [(k, "\n".join(changed(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "  ", "short", sentence(rng, 6)]) for _ in range(rng.randrange(1, 8))), 9) for k in range(40)]
    rows += [(None, None, 1), (98, "", 1), (99, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    first = {}
    for k, t, _ in order:
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (k, p))
    long = [x for x in first if len(x) >= 3]
    links = {x: [y for y in long if x != y and edits(x, y) <= 2] for x in long}
    assert sum(map(len, links.values())) > 20
    got = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    for k, t, _ in order:
        lines = t.split("\n")
        goes = [bool(x.strip()) and (first[x] != (k, p) or any(first[y] < first[x] for y in links.get(x, ()))) for p, x in enumerate(lines)]
        r = got[k]
        assert r.text == "\n".join(x for x, g in zip(lines, goes, strict=True) if not g)
        assert (r.n_lines, r.n_removed, r.n_links) == (sum(bool(x.strip()) for x in lines), sum(goes), sum(len(links.get(x, ())) for x in lines))
    assert (got[None].text, got[None].n_lines) == (None, 0)
    assert linededup.dedup_lines(none).count() == 0
    fresh = {r.doc_id for r in linededup.keep_fresh(frame).select("doc_id").collect()}
    assert fresh >= {None, 98} and 99 not in fresh


@pytest.mark.parametrize("distance", [1, 2, 4])
def test_edit_distance_in_a_band(spark, distance):
    rng = random.Random(12)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.randrange(0, 30)))
        b = a
        for _ in range(rng.randrange(distance + 3)):
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("xb ") + b[i:], b[:i] + rng.choice("xb ") + b[i + 1 :]])
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), distance).alias("n")).collect()
    assert any(r.n == distance for r in got) and any(r.n is None for r in got)
    assert [r.n for r in got] == [n if (n := edits(a, b)) <= distance else None for a, b in pairs]


@pytest.mark.parametrize("distance", [1, 2])
def test_equal_ends_take_no_part_in_verification(spark, distance):
    """Runs of one letter, whose equal ends overlap, and texts around the lengths of runs."""
    rng = random.Random(5)
    pairs = [("a" * m, "a" * n) for m in range(14) for n in range(14)]
    pairs += [("a" * i + "b" + "a" * j, "a" * k + "b" + "a" * n) for i, j, k, n in (rng.choices(range(12), k=4) for _ in range(150))]
    for n in (15, 16, 17, 64, 65, 130):
        text = "".join(rng.choice("ab") for _ in range(n))
        pairs += [(text, text[:i] + rng.choice(["", "x", "\u00e9a"]) + text[i + rng.randrange(3) :]) for i in range(0, n, 3)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), distance).alias("n")).collect()
    assert all(r.n == (n if (n := edits(r.a, r.b)) <= distance else None) for r in got)


def test_a_text_is_not_split_anew_for_each_of_its_lines(spark):
    lines = [f"line number {k} of a long document" + "!" * (k % 7) * 5 for k in range(400)]
    frame = spark.createDataFrame([(1, "the same line stands twice here"), (2, "\n".join([lines[0], "the same line stands twice here", *lines[1:]]))], "doc_id long, text string")
    fresh = linededup.keep_fresh(frame, 1)
    assert "lambdafunction(split(" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    kept = {r.doc_id: r.text.split("\n") for r in fresh.collect()}
    assert kept[1] == ["the same line stands twice here"] and kept[2] == [x for x in lines if x in set(kept[2])] and len(kept[2]) > 1


def test_repeated_rows_count_once(spark):
    one = "a line that stands here\nand another one that stands"
    rows = [(1, one), (1, one), (2, "a line that stands hero"), (2, "a line that stands hero")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_links) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, one, 2, 0, 1), (2, "", 1, 1, 1)}


def test_short_lines_are_linked(spark):
    lines = ["ab", "ac", "abc", "abd", "xyz", "abxyc", "Aton thonat and.", "Atin thonat, and.", "Ouéou tionoiment.", "Ouéou | tionoiment.", "q" * 23, "q" * 24, "q" * 26, "short line here", "other"]
    expected = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if min(len(lines[a]), len(lines[b])) >= 3 and edits(lines[a], lines[b]) <= 2}
    found = linededup.line_links(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {tuple(sorted((r.first_a.did, r.first_b.did))) for r in found} == expected and len(found) == len(expected) >= 6


@pytest.mark.parametrize("distance", [1, 2, 4])
def test_lines_at_the_borders_of_lengths_are_linked(spark, distance):
    rng = random.Random(8)
    lines = []
    for size in [*range(5, 13), 17, 18, *range(28, 38), 47, 48, 49, *range(61, 75), 79, 80, 81, 95, 96, 97]:
        base = "".join(rng.choice("ab é\U0001f600") for _ in range(size))
        lines.append(base)
        for _ in range(6):
            line = base
            for _ in range(rng.randrange(1, distance + 1)):
                i = rng.randrange(len(line))
                line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("xa ") + line[i:], line[:i] + rng.choice("xa ") + line[i + 1 :]])
            lines.append(line)
        first, middle, last = base[: size // 3], base[size // 3 : -(size // 3)], base[-(size // 3) :]
        lines += ["x" + first[1:] + middle + last[:-1] + "x", first[1:] + middle + last + "x", "x" + first + middle + last[:-1], "x" + first + middle + last + "x", first[1:] + middle + last[:-1]]
    lines = [x for x in dict.fromkeys(lines) if x.strip()]
    expected = {(a, b): n for a in range(len(lines)) for b in range(a + 1, len(lines)) if abs(len(lines[a]) - len(lines[b])) <= distance < min(len(lines[a]), len(lines[b])) and (n := edits(lines[a], lines[b])) <= distance}
    found = linededup.line_links(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), distance).collect()
    assert len(found) == len(expected) > 100
    assert {tuple(sorted((r.first_a.did, r.first_b.did))): r.edits for r in found} == expected


def test_few_keys_for_a_line(spark):
    texts = spark.range(24, 280).selectExpr("id AS h", "repeat('x', int(id)) AS line", "int(id) AS length", "0L AS letters")
    keys = [linededup.keyed(texts, 2, index).groupBy("h").count().collect() for index in (True, False)]
    assert {r["count"] for r in keys[0]} == {3}
    assert sum(r["count"] for r in keys[1]) < 6 * 256  # 12 for each line before
    assert {r["count"] for r in keys[1] if r.h >= 64} == {4, 7, 8}


def test_letters_of_lines_that_share_nothing_are_not_counted(spark, monkeypatch):
    counted = linededup.letters
    monkeypatch.setattr(linededup, "letters", lambda text: F.when(text.startswith("alone"), F.raise_error(F.lit("counted")).cast("long")).otherwise(counted(text)))
    lines = ["alone in the first of lines", "alone, and of another kind 7", "two of these stand close", "two of these stood close", "=" * 40, "=" * 41]
    found = linededup.line_links(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {(*sorted((r.first_a.did, r.first_b.did)), r.edits) for r in found} == {(2, 3, 2), (4, 5, 1)} and len(found) == 2


@pytest.mark.parametrize("distance", [1, 2, 4])
def test_own_keys_are_the_index(spark, distance):
    texts = spark.range(distance + 1, 200).selectExpr("id AS h", "substr(repeat(sha2(string(id), 256), 4), 1, int(id)) AS line", "int(id) AS length")
    own, index = (sorted(map(tuple, rows.select("h", "key").collect())) for rows in (linededup.keyed(texts, distance, False).where("own"), linededup.keyed(texts, distance, True)))
    assert own == index and len(own) == (distance + 1) * (199 - distance)


def test_kinds_of_white_space(spark):
    blank = " \t\v\f\r "
    text = f"{blank}\n\u00a0\n\n{blank}x\n{blank}\n\u00a0\n\u2028"
    got = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.text, got.n_lines, got.n_removed, got.n_links) == (f"{blank}\n\u00a0\n\n{blank}x\n{blank}\n\u2028", 4, 1, 0)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.normal(size=20)], 1) for k in range(300)]
    rows += [(300, rows[0][1], 1), (301, rows[0][1], 1), (302, None, 1), (303, [1.0, None] * 10, 1), (304, [float("nan")] * 20, 1), (350, [float("inf")] * 20, 1), (400, [0.5, 0.25], 1), (401, [1.0, 1.0], 1), (7, rows[7][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    whole = [(k, [math.floor(256 * x) for x in v]) for k, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in {k: v for k, v in whole if k % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), k) for k, x in whole if k != q and len(x) == len(v))[:5]
        expected |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, is_query="vec_id % 50 = 0").collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert topk.top_k(frame.limit(0), is_query="vec_id % 50 = 0").count() == 0
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, is_query="vec_id % 50 = 0").collect()} == expected
    large = spark.createDataFrame([(0, [1e16, 1e16]), (1, [1e16, 3.0]), (2, [-1e300, 1.0]), (3, [1e308, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(large, is_query="vec_id = 0").orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63) + 1)]


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates(spark, docs, none, threshold):
    rng = random.Random(8)
    texts = {}
    for k in range(120):
        words = texts[rng.randrange(k)].split() if k and rng.random() < 0.7 else sentence(rng, rng.choice([4, 6, 9, 12, 40, 150])).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        texts[k] = " ".join(words)
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, t in texts.items() for w in [t.split()]}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), threshold).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}
    edge = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [edge[k].n_shingles for k in (43, 44, 45, 46)] == [0, 0, 0, 1]
    assert (edge[None].component_id, edge[None].kept) == (None, False)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_first(docs).where("doc_id IS NULL").count() == 1


def test_main_text_of_odd_pages():
    text = "<p>The first text, which is long, and has commas.</p><p>Another, of the same kind.</p>"
    plain = "The first text, which is long, and has commas. Another, of the same kind."
    for page in ('<div class="post has-comments">{}</div>', '<div class="article share-enabled">{}</div>', '<form id="aspnetForm"><div>{}</div><input></form>', "<div class=related>{}</div>", "a <b <c> {}", '<p title="open>x</p>{}'):
        assert plain in maintext.extract(page.format(text * 4))
    began = time.time()
    for part in ("<a ", "<a '\">", "<!--", "</", "<!", "<li><div>", "<div>x", "<p>a<b>", "<tr><b>"):
        maintext.extract(part * 20_000)
    maintext.extract("<b>" * 20_000 + "<tr>" * 20_000)
    for page in ("<b>" * 20_000 + "x<hr>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "</" * 200_000 + ">", "<a \"'>" * 40_000, "<blockquote>" * 20_000 + "x<hr>" * 20_000, "<ul><li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000):
        maintext.extract(page)
    maintext.extract("<div>" * 20_000 + "x" + "</p>" * 20_000)
    assert time.time() - began < 60


def test_main_text():
    page = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><div id=cookie-notice>We use cookies</div><ul class="menu"><li><a href=a>A</a><li><a href=b>B</a></ul>
<main><h1>Head &amp; line</h1><section><p>First, para one, with <b>bo</b>ld text that is long enough.</p><div class="ad">Buy</div><p>Second<br>line,&nbsp;here we are.</p></section><section><h2>More</h2><ul><li>one<li>two</ul><form><input>Sub</form></section>
<section id="comments"><p>I hate it, really, really, really, a lot, ok, this is longer than all</p></section></main><aside>side</aside><footer>&copy; f</footer>"""
    assert maintext.extract(page) == "Head & line First, para one, with bold text that is long enough. Second line, here we are. More one two"
    assert [maintext.extract(x) for x in ("", "plain", "<p>x<p>y", "<script>x", "<div>a<div class=sidebar>c</div>d", "<!-- open")] == ["", "plain", "x y", "", "a d", ""]


def test_main_text_rows(spark):
    frame = spark.createDataFrame([(1, "u", None, 3), (1, "u", "<p>a  b</p>", 3), (None, None, "é", 3)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in maintext.main_text(frame).collect()) == [("", 0), ("a b", 3), ("é", 1)]
    assert maintext.main_text(frame.limit(0)).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 40) + ".") for k in range(150)] + [(k, " ".join(w.upper() + "!!" for w in sentence(rng, 40).split())) for k in range(150, 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame, labels).toPandas()
    assert (got.predicted == (got.doc_id < 150)).mean() > 0.97
    assert got.held_out.sum() == sum(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(300))
    assert set(quality.classify(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels).count() == docs.count()


def test_only_documents_that_may_teach_have_statistics_for_the_model(spark, docs, monkeypatch):
    seen, taken = [], quality.with_statistics
    monkeypatch.setattr(quality, "with_statistics", lambda rows: seen.append(rows) or taken(rows))
    quality.keep_good(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    ids = {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None}
    assert {r.doc_id for r in seen[0].where("doc_id IS NOT NULL").select("doc_id").collect()} == {i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2} != ids


def test_texts_meet_few_duplicates_without_a_shuffle(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(40)]
    kept = minhash.keep_first(spark.createDataFrame([*rows, (99, rows[3][1])], "doc_id long, text string"))
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in kept.collect()} == set(range(40))


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    real = Tokenizer.from_file(path)
    rng = random.Random(1)
    some = ["Hello  Wörld's <|endoftext|>abc 123 \x00 éé", "İstanbul ΑΣ ß", "á é", "it's I'LL don'T", "<|STARTOFTEXT|>", "½²Ⅷ", "", "  ", None, "aaaaaaaa!!!!!! hahahaha", "x" * 5000, "日本語 テスト　한국어"]
    some += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x390, 0x3D0)])) for _ in range(rng.randrange(40))) for _ in range(300)]
    encoder = bpe.Encoder(path)
    ids, at = encoder.encode(pa.array(some, pa.string()))
    data, bounds = encoder.words.decode(ids, at)
    for k, text in enumerate(some):
        expected = real.encode(text or "", add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == expected
        assert data[bounds[k] : bounds[k + 1]].tobytes().decode() == real.decode(expected, skip_special_tokens=False)
    # every code point outside the large blocks of ideographs and syllables, and words that a rolling hash would confuse
    points = [f"a{chr(c)}b 1{chr(c)}" for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x18A00, 0x19300), *range(0x1AFF0, 0x1FC00), 0x2B73A, 0x323B0, 0x3D000, 0x10FFFF]]
    ab = "a"
    while len(ab) < 1024:
        ab += ab.translate({97: 98, 98: 97})
    points.append(ab + " " + ab.translate({97: 98, 98: 97}))
    ids, at = encoder.encode(pa.array(points, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in real.encode_batch(points, add_special_tokens=False)]
    got = bpe.encoded(docs, path)
    assert got.columns == ["doc_id", "text", "lang", "block", "score", "ids", "n_tokens"]
    back = {r.doc_id: r.text for r in bpe.decoded(got, path).collect()}
    assert back[0] == real.decode(real.encode(docs.where("doc_id = 0").first().text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encoded(none, path).count() == 0 and bpe.digests(none, path).count() == 0
    assert bpe.digests(docs, path).count() == docs.count()
