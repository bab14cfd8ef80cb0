"""Circulant MinHash against brute-force Jaccard similarity of word shingles."""

import random

import brute
import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from hintwise.llm import minhash


def shingle_set(text):
    w = brute.words((text or "").translate(brute.TABLE))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_roots(texts):
    """The group of each text, by its first member; a text without words is alone."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=6))


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = word(rng)
    return out


def edited():
    """Copies of which some words are changed, and strangers that one phrase dominates."""
    rng = random.Random(5)
    texts = []
    for n in (60, 150, 400):
        for _ in range(12):
            base = [word(rng) for _ in range(n)]
            texts.append(" ".join(base))
            texts += [" ".join(changed(rng, base, k)) for k in (1, 2, n // 60, n // 40, n // 20)]
    texts += ["one and the same phrase again " * 200 + " ".join(word(rng) for _ in range(40)) for _ in range(6)]
    rng.shuffle(texts)
    return texts


def one_group():
    """Copies of one text with few to many changes: similarities to each other from 0.2 to 1."""
    rng = random.Random(6)
    base = [word(rng) for _ in range(120)]
    return [" ".join(changed(rng, base, rng.randint(0, 12))) for _ in range(150)]


def boilerplate(n):
    """Strangers that share about three quarters of their words: none is similar enough."""
    rng = random.Random(7)
    shared = [word(rng) for _ in range(90)]
    return [" ".join(shared + [word(rng) for _ in range(30)]) for _ in range(n)]


@pytest.mark.parametrize("kind", ["edge", "corpus", "edited", "one_group", "boilerplate"])
@pytest.mark.parametrize("block", [None, 3000])
def test_against_brute_force(spark, sf, monkeypatch, kind, block):
    if block and kind in ("edge", "corpus"):
        pytest.skip("blocks matter in large groups")
    if block:
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    made = {"edited": edited, "one_group": one_group, "boilerplate": lambda: boilerplate(150)}
    docs = {"edge": edge.documents, "corpus": lambda s: s.read.parquet(f"{sf}/documents.parquet")}.get(
        kind, lambda s: s.createDataFrame(list(enumerate(made[kind]())), "doc_id long, text string"))(spark)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    roots = brute_roots([r.text for r in rows])
    want = [(r.doc_id, len(shingle_set(r.text)), rows[g].doc_id, r.doc_id == rows[g].doc_id) for r, g in zip(rows, roots)]
    found = minhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    if kind in made:
        assert len(set(roots)) > 3


def test_rows_grow_with_the_texts_not_their_pairs(spark, monkeypatch):
    """What is compared by joins, and what cells return, is counted on more and more boilerplate."""
    counted, wrote = [], minhash.written

    def counting(df, name):
        out = wrote(df, name)
        if name in ("pairs", "more-links"):
            counted.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "written", counting)
    for n in (100, 400):
        docs = spark.createDataFrame(list(enumerate(boilerplate(n))), "doc_id long, text string")
        assert minhash.near_duplicates(docs).where("kept").count() == n
    pairs = [n for name, n in counted if name == "pairs"]
    assert pairs[1] < 8 * max(pairs[0], 100)
    assert all(n == 0 for name, n in counted if name == "more-links")


def test_circulant_signature():
    """Coordinate k is the least of one permutation shifted by k places, and agrees with a probability of the similarity."""
    rng = np.random.default_rng(1)
    found = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    got = minhash.signature(found, 40)
    for k in (0, 1, 39):
        places = [(int(minhash.permuted(np.uint32([x & 0xFFFFFFFF]), 0x7FEB352D, 0x846CA68B)[0]) - k * minhash.STEP) % 2 ** 32 for x in found.tolist()]
        assert got[k] == minhash.permuted(np.uint32(places), 0x21F0AAAD, 0x735A2D97).min()
    values = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.permuted(values, 0x21F0AAAD, 0x735A2D97))) == 1 << 16
    for similarity in (0.5, 0.8):
        agree = []
        for _ in range(60):
            n = 400
            shared = int(2 * n * similarity / (1 + similarity))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared).astype(np.uint64)])
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - similarity) < 0.02


def test_recall_of_bands():
    """Pairs of similarity 0.8 and a little more share a band."""
    rng, missed = random.Random(8), 0
    for _ in range(300):
        base = [word(rng) for _ in range(200)]
        a = minhash.shingles(" ".join(base))
        b = minhash.shingles(" ".join(changed(rng, base, 5)))
        shared = len(np.intersect1d(a, b))
        assert 0.75 <= shared / (len(a) + len(b) - shared) <= 0.95
        missed += not (minhash.band_keys(a) == minhash.band_keys(b)).any()
    assert missed == 0


def test_nothing(spark):
    assert minhash.near_duplicates(edge.empty(spark)).count() == 0
    lonely = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id long, text string")
    got = minhash.near_duplicates(lonely)
    assert got.where(F.col("kept") & (F.col("n_shingles") == 0)).count() == 3
