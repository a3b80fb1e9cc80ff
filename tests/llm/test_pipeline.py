"""The pipeline against a plain version of its five stages, and its stages on odd tables."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factweave.llm import quality
from tests.llm.test_operators import edits, plain_overlaps, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(texts, labels):
    """Scores of all texts by the formula of the discriminant; labels: quality of every text that teaches."""
    x = quality.document_statistics(pa.array(texts, pa.string()))
    own = {c: x[[k for k, y in labels.items() if y == c]] for c in (0, 1)}
    n = {c: len(own[c]) for c in own}
    cov = {c: np.cov(own[c].T, bias=True) for c in own}
    joint = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    logs = {}
    for c in (0, 1):
        mix = 0.8 * cov[c] + 0.1 * joint + 0.1 * np.diag(np.diag(cov[c])) + np.eye(x.shape[1]) * (1e-4 + 1 / (n[c] + 1))
        apart = x - own[c].mean(axis=0)
        logs[c] = np.log(n[c] / (n[0] + n[1])) - 0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(mix), apart) - 0.5 * np.linalg.slogdet(mix)[1]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def plain_lines(docs):
    """(id, text) without lines that stand, or nearly stand, earlier."""
    first = {}
    for k, text in docs:
        for p, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (k, p))
    gone = {a for a in first for b in first if first[b] < first[a] and min(len(a), len(b)) > 2 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    out = []
    for k, text in docs:
        kept = [line for p, line in enumerate(text.split("\n")) if not line.strip() or first[line] == (k, p) and line not in gone]
        if "\n".join(kept).strip() or len(kept) == text.count("\n") + 1:
            out.append((k, "\n".join(kept)))
    return out


def plain_near(docs, threshold=80):
    """The first document of each group of near duplicates."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, t in docs for w in [tokens(t)]}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    return [(k, t) for k, t in docs if root[k] == k]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(30), line(25)]
    texts = {}
    for k in range(150):
        kind = k % 10
        lines = [line(rng.randrange(6, 14)) + "." for _ in range(rng.randrange(2, 5))]
        if kind == 3 and k > 20:
            lines[0] = texts[k - 13].split("\n")[0]
        elif kind == 4 and k > 20:
            lines[0] = texts[k - 14].split("\n")[0].replace("a", "o", 1)
        elif kind == 5 and k > 20:
            lines = [w for t in [texts[k - 15].split("\n")] for w in [" ".join(t).replace("b", "bb", 1) + " more"]]
        elif kind == 6:
            lines[1] = line(3) + " " + rng.choice(items).replace("e", "ee", 1) + " " + line(2)
        elif kind in (8, 9):
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        texts[k] = "\n".join(lines)
    texts |= {200: None, 201: "", 202: texts[0]}
    path = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", None if k % 7 else "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = {k: int(k % 10 < 8) for k in range(150)}
    spark.createDataFrame([(k, y, 0) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate([*items, None])), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, labels, items


def test_run_by_brute_force(spark, folder):
    path, texts, labels, items = folder
    ids = list(texts)
    score = dict(zip(ids, plain_quality(list(texts.values()), {ids.index(k): y for k, y in labels.items() if zlib.crc32(str(k).encode()) % 4 != 2}), strict=True))
    classified = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert classified == pytest.approx(score, abs=1e-6)
    good = [(k, t or "") for k, t in texts.items() if score[k] >= 0.7]
    fresh = plain_lines(good)
    single = plain_near(fresh)
    dirty = {d for d, _ in plain_overlaps([t for _, t in single], items)}
    expected = [row for n, row in enumerate(single) if n not in dirty]
    assert len(texts) > len(good) > len(single) > len(expected) > 50 and dict(fresh) != dict(good)
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {k: r.text or "" for k, r in rows.items()} == dict(expected)
    for k, t in expected:
        assert rows[k].ids == real.encode(t, add_special_tokens=False).ids and rows[k].n_tokens == len(rows[k].ids) and (rows[k].n_chars or 0) == len(t)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, folder, name, stage):
    none = spark.createDataFrame([], SCHEMA + ", score double, node long, part int")
    out = stage(spark, none, folder[0])
    assert out.count() == 0 and set(none.columns) <= set(out.columns)
    odd = spark.createDataFrame([(None, None, None, None, None, 1.0, 2, 3), (1, "", "en", "s", 0, 1.0, 2, 3), (1, "", "en", "s", 0, 1.0, 2, 3)], none.schema)
    assert stage(spark, odd, folder[0]).count() in (0, 3)


def test_given_tables(spark):
    path = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    rows = out.count()
    assert 0 < rows < docs.count() and out.select("doc_id").distinct().count() == rows
