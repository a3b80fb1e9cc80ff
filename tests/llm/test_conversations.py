"""Structure repair and the prefix trie against plain versions."""

import hashlib
import functools
import random
import re
import zlib
from collections import defaultdict

import pytest

from factweave.llm import ordered, prefixtrie, repair

SCHEMA = "conv_id long, turn long, role string, text string, depth long, pos long, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_conversations(seed, convs, most, texts, *, first=0):
    """Rows with few different texts, so that prefixes are shared; nulls, ties and repeated rows among them."""
    rng = random.Random(seed)
    rows = []
    for c in range(first, first + convs):
        if rng.random() < 0.1:
            continue
        own = []
        for t in range(rng.randrange(1, most + 1)):
            role = rng.choice(["user", "assistant", "system", None, ""]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            text = rng.choice([None, "", " \t", "é" * 3]) if rng.random() < 0.1 else f"text {rng.randrange(texts)}" + rng.choice([".", "!", "?", "", ". "])
            own.append((c, None if rng.random() < 0.05 else t, role, text))
            if rng.random() < 0.1:
                own.append(own[-1])
        rows += own
    rows += [(None, 1, "user", "no conversation."), (None, None, None, None)]
    rng.shuffle(rows)
    return [(*r, 1, 2, "x") for r in rows]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            whole = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), role, whole, text))
    for turns in own.values():
        turns.sort()
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = [(r, t) for _, r, _, t in own.get(c - c % 100, [])[:h] + turns[h:]]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie(spark, rows):
    found = prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, found.collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed,convs,most,texts", [(1, 60, 8, 3), (2, 230, 5, 2), (3, 12, 40, 1)])
def test_trie(spark, seed, convs, most, texts):
    rows = random_conversations(seed, convs, most, texts)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_long_conversation(spark):
    rows = [(c, t, "user", "same", 1, 2, "x") for c in (100, 101, 102) for t in range(77 + c % 3)] + [(205, 0, "user", "same", 1, 2, "x")]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_edges(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x", 1, 2, "x")]) == []
    h = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    alone = [(h, 0, "user", "its only turn goes, and no first conversation is there", 1, 2, "x")]
    assert trie(spark, alone) == [(h, 0, None, 1, 0, 1, 0, sha(str(h)))]


def test_places(spark):
    rows = [(g, v) for g in (None, 1, 2, 2**40) for v in [None, *range(500), 7, 7]]
    random.Random(1).shuffle(rows)
    found = ordered.places(spark.createDataFrame(rows, "g long, v long").repartition(7), "g", ["v"])
    by = defaultdict(list)
    for g, v, pos in found.collect():
        by[g].append((pos, -1 if v is None else v))
    assert len(by) == 4
    for got in by.values():
        got.sort()
        assert [p for p, _ in got] == list(range(503))
        assert [v for _, v in got] == sorted([-1, *range(500), 7, 7])


def plain_edits(rows):
    """Cost and audit of the cheapest edits, ASCII-least, and their repaired turns, by recursion over suffixes. rows: role, text, fault."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def best(k, state, room):
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if room:
            for x in "ua":
                if x in step[state]:
                    cost, audit, out = best(k, x, room - 1)
                    found.append((cost + 5, "I" + audit, (f"{names[x]}:", *out)))
        if k < len(rows):
            role, text, fault = rows[k]
            cost, audit, out = best(k + 1, state, 2)
            found.append((cost + 2, "D" + audit, out))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                ways = [("K", 0, role[:1], role)] + [("R", 1, x, names[x]) for x in "ua"]
                for letter, price, x, name in ways:
                    if x in step[state]:
                        cost, audit, out = best(k + 1, x, 2)
                        found.append((cost + price + more, letter + audit, (f"{name}:{text}", *out)))
        return min(found, default=(10**9, "~", ()), key=lambda f: f[:2])

    for k in range(len(rows), -1, -1):  # shorter suffixes first, so that recursion stays flat
        for state in step:
            best(k, state, 2)
    return best(0, "", 2)


def plain_repair(rows):
    left = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        left[c]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        left[c] += [] if fate == 0 else [((turn is not None, turn or 0), role, name, text)] * (2 if fate == 3 else 1)
    out = {}
    for c, own in left.items():
        own.sort()
        seen, judged = set(), []
        for _, role, _, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, turns = plain_edits(judged)
        numbers = [t for (known, t), *_ in own if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(f == x for *_, f in judged) for x in ("blank", "duplicate", "truncated")]
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(judged, judged[1:]))
        out[c] = (gaps, *count, illegal, cost, audit, sha("\n".join(turns)))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, rows, **more):
    found = repair.repair(spark.createDataFrame(rows, SCHEMA), **more).collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("seed,convs,most,texts,chunk", [(1, 300, 9, 40, repair.CHUNK), (2, 40, 60, 500, 3), (3, 6, 400, 4000, 16)])
def test_repair(spark, seed, convs, most, texts, chunk):
    rows = random_conversations(seed, convs, most, texts)
    assert repaired(spark, rows, chunk=chunk) == plain_repair(rows)


def test_repair_edges(spark):
    assert repaired(spark, []) == {}
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(10**6) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(6)))
    rows = [(dropped, 0, "user", "gone.", 1, 2, "x")]
    rows += [(whole, t, r, x, 1, 2, "x") for t, (r, x) in enumerate([("", "no role."), ("service", "an s."), ("user", "hi\x0b?\n"), ("tool", "t!"), ("user", "hi\x0b?\n"), ("Assistant", "capital.")])]
    rows += [(None, None, None, None, 1, 2, "x")] * 3
    found = repaired(spark, rows)
    assert found == plain_repair(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_long_conversation_converges(spark):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], f"t{t}" + rng.choice(["."] * 9 + [""]), 1, 2, "x") for t in range(3000)]
    assert repaired(spark, rows, chunk=100) == plain_repair(rows)


def test_rerun_equals_a_full_run():
    rng = random.Random(4)
    for _ in range(300):
        letters = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 40)))
        old, new = (tuple(rng.randrange(12) for _ in range(4)) for _ in range(2))
        start = repair.level(repair.costs(letters, old)[0])
        assert repair.rerun(letters, old, new, start) == repair.level(repair.costs(letters, new)[0])
