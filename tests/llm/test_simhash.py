"""SimHash fingerprints and the self-join of their trie against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import simhash

SCHEMA = "doc_id long, text string, bits string, root long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, budget=3):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(prints)):
        if ids[k] is not None:
            least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return [least.get(root(k)) for k in range(len(prints))]


def some_texts(rng):
    words = [f"w{k}" for k in range(40)]
    out = [None, "", " \t\n", "a", "A", "a b", "a\x0bb", "Été\tİ one", "x" * 5000, "word " * 70_000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            base = list(base)
            base[rng.randrange(len(base))] = "other"
            out.append("  ".join(base).upper())
    return out


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    texts = some_texts(rng)
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, texts[12], "x", 1), (None, "alone in the world with its words", "x", 1), (12, texts[12], "x", 1)]
    rng.shuffle(rows)
    prints = [plain_fingerprint(r[1]) for r in rows]
    wanted = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components(prints, [r[0] for r in rows]), strict=True)]
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    docs = spark.createDataFrame(rows, SCHEMA)
    for most in (simhash.LEAVES, 20):
        assert sorted(map(tuple, simhash.near_duplicates(docs, most=most).collect()), key=order) == sorted(wanted, key=order)


def test_one_shingle_is_its_hash(spark):
    """Of a text of up to three words the fingerprint is the session's own xxhash64 of them."""
    own = spark.range(1).select(F.xxhash64(F.lit("Ünï çödé text"))).first()[0] % 2**64
    assert int(simhash.fingerprints_of(pa.array([" Ünï  çödé\tTEXT\n"]))[0]) == own


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = {0, 2**64 - 1}
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n,budget", [(1, 3), (2, 3), (500, 3), (500, 0), (300, 6)])
def test_forest_of_one_node(n, budget):
    leaves = clustered(random.Random(n), n)[:n]
    u, v = simhash.forest(np.array(leaves, np.uint64), None, 0, 0, budget)
    place = {x: k for k, x in enumerate(leaves)}
    label = simhash.merged(np.arange(n), np.array([place[int(x)] for x in u], int), np.array([place[int(x)] for x in v], int))
    assert label.tolist() == plain_components(leaves, list(range(n)), budget)


@pytest.mark.parametrize("most", [8, 200, 10_000])
def test_join_of_a_trie_cut_at_any_size(spark, most):
    leaves = clustered(random.Random(9), 300)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in leaves], "bits long")
    place = {x: k for k, x in enumerate(leaves)}
    edges = [(place[r.u % 2**64], place[r.v % 2**64]) for r in simhash.links(frame, 3, most).collect()]
    label = simhash.merged(np.arange(300), np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
    assert label.tolist() == plain_components(leaves, list(range(300)))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
