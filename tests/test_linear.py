"""Linear learners against dense fits that share no code with them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hintwise.operators import linear
from hintwise.operators.textmodel import Head


def texts(n=80, seed=3):
    """Texts of two topics, one empty and one null, with a class of three and four tags."""
    rng = random.Random(seed)
    words = [["alpha", "beta", "gamma", "common"], ["delta", "eps", "zeta", "common"], ["eta", "theta", "common", "beta"]]
    rows = []
    for i in range(n):
        y = rng.randrange(3)
        rows.append((i, " ".join(rng.choices(words[y] + [f"rare{i % 7}"], k=rng.randint(1, 9))), y if rng.random() < 0.9 else 0,
                     [int(rng.random() < 0.5) for _ in range(3)] + [int(y == 1)]))
    return [*rows, (n, "", 1, [1, 0, 0, 0]), (n + 1, None, 2, [0, 1, 0, 0])]


def dense_fit(rows, reg):
    """Newton's method on the dense problem: vocabulary and weights, bias last; three class columns, four tag columns."""
    bags = [(t or "").split() for _, t, _, _ in rows]
    vocabulary = sorted({w for b in bags for w in b})
    idf = np.array([math.log((len(rows) + 1) / (sum(w in b for b in bags) + 1)) + 1 for w in vocabulary])
    x = np.array([[b.count(w) for w in vocabulary] for b in bags]) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.hstack([np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), np.ones((len(rows), 1))])
    n, d = x.shape
    classes = np.eye(3)[[r[2] for r in rows]]
    w = np.zeros((3, d))
    for _ in range(60):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - classes).T @ x / n + reg * w).ravel()
        h = np.zeros((3 * d, 3 * d))
        for a in range(3):
            for b in range(3):
                weight = p[:, a] * ((a == b) - p[:, b])
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] = (x * weight[:, None]).T @ x / n
        w -= np.linalg.solve(h + reg * np.eye(3 * d), g).reshape(3, d)
    tags = []
    for k in range(4):
        v, y = np.zeros(d), np.array([r[3][k] for r in rows])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ v))
            v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + reg * np.eye(d), x.T @ (p - y) / n + reg * v)
        tags.append(v)
    return vocabulary, np.vstack([w, tags]).T


HEADS = [Head("h", "y", 3), Head("m", "tags", 4, multi=True)]


@pytest.mark.parametrize("chunk,block", [(1 << 16, 1 << 16), (5, 20)])
def test_weights_equal_a_dense_fit(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(linear, "CHUNK_CELLS", chunk)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", block)
    rows = texts()
    df = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>").repartition(5)
    model = linear.fit_text_labels_lr(df, "id", "text", HEADS, regularization=0.02)
    vocabulary, want = dense_fit(rows, 0.02)
    got = {r.token: r.weights for r in model.words.collect()}
    assert sorted(got) == vocabulary
    assert np.abs(np.array([got[w] for w in vocabulary]) - want[:-1]).max() < 1e-7
    assert np.abs(np.array(model.bias) - want[-1]).max() < 1e-7
    # logits: what the weights say of a text, unknown words left out
    asked = spark.createDataFrame([(1, "alpha alpha unseen"), (2, None), (3, "unseen")], "id bigint, text string")
    out = {r.id: [*r.h, *r.m] for r in linear.predict_text_labels_lr(model, asked, "id", "text").collect()}
    assert out[1] == pytest.approx(want[vocabulary.index("alpha")] + want[-1], abs=1e-6)
    assert out[2] == pytest.approx(want[-1], abs=1e-6) and out[3] == pytest.approx(want[-1], abs=1e-6)


def test_one_job_per_evaluation_whatever_the_tags(spark):
    """Jobs of one gradient, for two tags and for forty."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for tags in (2, 40):
        rows = spark.createDataFrame([([0, 1], [0.6, 0.8], [0]), ([1], [1.0], [])], "terms array<int>, values array<double>, classes array<int>")
        spark.sparkContext.setJobGroup(f"gradient-{tags}", "x")
        loss, gradient = linear.summed_gradient(rows, np.zeros((3, tags)), (Head("m", "t", tags, multi=True),))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(tracker.getJobIdsForGroup(f"gradient-{tags}")))
        assert loss == pytest.approx(2 * tags * math.log(2)) and gradient.shape == (3, tags)
        assert gradient[0, 0] == pytest.approx(-0.3) and gradient[2, 1] == pytest.approx(1.0)
    assert jobs[0] == jobs[1] <= 2


def test_too_many_words_are_refused(spark, monkeypatch):
    monkeypatch.setattr(linear, "MOST_WEIGHT_BYTES", 100)
    df = spark.createDataFrame(texts(), "id bigint, text string, y int, tags array<int>")
    with pytest.raises(ValueError, match="min_texts"):
        linear.fit_text_labels_lr(df, "id", "text", HEADS)


def test_rare_words_on_request(spark):
    df = spark.createDataFrame([(1, "one two", 0), (2, "one", 1), (3, "one two three", 1)], "id bigint, text string, y int")
    model = linear.fit_text_labels_lr(df, "id", "text", [Head("h", "y", 2)], min_texts=2)
    assert {r.token for r in model.words.collect()} == {"one", "two"}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "id bigint, text string, y int")
    model = linear.fit_text_labels_lr(none, "id", "text", [Head("h", "y", 2)])
    assert model.bias == (0.0, 0.0) and model.words.count() == 0
    features = spark.createDataFrame([], "shared double, jaccard double, idf_share double, label double")
    assert linear.fit_pair_relevance(features).weights == (0.0, 0.0, 0.0, 0.0)


def test_pair_relevance_equals_a_dense_fit(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 3)), rng.randint(0, 4) / 4, rng.randint(0, 2) / 2) for _ in range(300)]
    rows = [(*r, float(rng.random() < 1 / (1 + math.exp(1 - r[0] - r[2])))) for r in rows]
    features = spark.createDataFrame(rows, "shared double, jaccard double, idf_share double, label double")
    model = linear.fit_pair_relevance(features)
    x, y, w = np.array([[1, *r[:3]] for r in rows]), np.array([r[3] for r in rows]), np.zeros(4)
    reg = np.diag([0, 0.001, 0.001, 0.001])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + reg, x.T @ (p - y) / len(y) + reg @ w)
    assert model.weights == pytest.approx(w, abs=1e-9) and model.steps < 15
    scored = linear.score_pair_relevance(model, features).first()
    assert scored.score == pytest.approx(1 / (1 + math.exp(-(w @ [1, *rows[0][:3]]))), abs=1e-9)
    # labels that one feature separates still have a minimum, and missing labels do not count
    split = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)] * 5 + [(0.0, 0.0, 0.0, 0.0)] * 5 + [(0.0, 0.0, 0.0, None)],
                                  "shared double, jaccard double, idf_share double, label double")
    by = linear.score_pair_relevance(linear.fit_pair_relevance(split), split).groupBy("shared").agg(F.max("score").alias("s")).collect()
    assert {r.shared: r.s > 0.9 for r in by} == {1.0: True, 0.0: False}


@pytest.mark.parametrize("cells", [1 << 13, 20])
def test_dealt_weights_equal_a_dense_fit(spark, monkeypatch, cells):
    """Weights that are dealt to tasks, and never one matrix anywhere."""
    def refused(*args):
        raise AssertionError("the driver got the matrix")

    monkeypatch.setattr(linear, "DRIVER_WEIGHT_BYTES", 0)
    monkeypatch.setattr(linear, "DEALT_CELLS", cells)
    monkeypatch.setattr(linear, "summed_gradient", refused)
    rows = texts(40)
    df = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>").repartition(3)
    model = linear.fit_text_labels_lr(df, "id", "text", HEADS, regularization=0.05)
    vocabulary, want = dense_fit(rows, 0.05)
    got = {r.token: r.weights for r in model.words.collect()}
    assert sorted(got) == vocabulary
    assert np.abs(np.array([got[w] for w in vocabulary]) - want[:-1]).max() < 1e-7
    assert np.abs(np.array(model.bias) - want[-1]).max() < 1e-7


def test_dealt_weights_take_few_steps(spark, monkeypatch):
    """The second derivatives by the most frequent words scale the steps."""
    monkeypatch.setattr(linear, "DRIVER_WEIGHT_BYTES", 0)
    monkeypatch.setattr(linear, "OFTEN_CELLS", 13 * 8 ** 2)
    rows = texts(40)
    df = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>").repartition(3)
    model = linear.fit_text_labels_lr(df, "id", "text", HEADS, regularization=0.05)
    vocabulary, want = dense_fit(rows, 0.05)
    got = {r.token: r.weights for r in model.words.collect()}
    assert len(vocabulary) > 7 and model.steps <= 22
    assert np.abs(np.array([got[w] for w in vocabulary]) - want[:-1]).max() < 1e-7
