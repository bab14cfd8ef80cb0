import math

import pytest
from pyspark.sql import functions as F

from hintwise.functions import vectors as V
from hintwise.operators import decoding, evaluation, linear, ranking, scaling, textmodel
from hintwise.operators.textmodel import Head


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(
        V.l2_normalize(F.col("a")).alias("n"), V.l2_normalize(F.col("z")).alias("nz"),
        V.cosine(F.col("a"), F.col("z")).alias("c0"), V.cosine(F.col("a"), F.col("a")).alias("c1"),
    ).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.nz == [0.0, 0.0]
    assert row.c0 == 0.0 and row.c1 == pytest.approx(1.0)


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "l array<double>")
    row = df.select(V.softmax(F.col("l")).alias("s"), decoding.softmax_argmax(F.col("l")).alias("b"),
                    V.cross_entropy(F.col("l"), F.lit(1)).alias("ce")).first()
    assert sum(row.s) == pytest.approx(1.0) and (row.b.idx, row.b.confidence) == (0, 0.5)
    assert row.ce == pytest.approx(math.log(2))


def test_naive_bayes_by_hand(spark):
    rows = [(1, "good fine good", 1, [1, 0]), (2, "bad", 0, [0, 0]), (3, "bad fine", 0, [1, 0])]
    train = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>")
    heads = [Head("h", "y", 2), Head("m", "tags", 2, multi=True)]
    model = textmodel.fit_text_labels(train, "text", heads)
    # class 1 has words good x2, fine; class 0 has bad x2, fine; three words in all
    asked = spark.createDataFrame([(9, "good unseen"), (8, "")], "id bigint, text string")
    out = {r.id: r for r in textmodel.predict_text_labels(model, asked, "id", "text").collect()}
    assert out[9].h == pytest.approx([math.log(3 / 5) + math.log(1 / 6), math.log(2 / 5) + math.log(3 / 6)])
    assert out[8].h == pytest.approx([math.log(3 / 5), math.log(2 / 5)])
    # tag 0 holds for texts 1 and 3: five words, two of them good; text 2 has one word
    assert out[9].m[0] == pytest.approx(math.log(3 / 2) + math.log(3 / 8) - math.log(1 / 4))
    assert out[9].m[1] == pytest.approx(math.log(1 / 4) + math.log(1 / 3) - math.log(3 / 9))


def test_frequent_words_of_a_large_model_stay_where_the_texts_are(spark, monkeypatch):
    """Only words that are rare or unknown meet the rest of the model; without the frequent ones, with all words looked up by
    shuffle, and with a small model, the logits are the same."""
    rows = [(1, "the good the fine " * 20, 1, [1, 0]), (2, "the bad the odd" * 9, 0, [0, 0]), (3, "bad rare", 0, [1, 0]), (4, None, 1, [0, 1])]
    train = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>")
    heads = [Head("h", "y", 2), Head("m", "tags", 2, multi=True)]
    asked = spark.createDataFrame([(1, "the the the good"), (2, "the unseen rare rare"), (2, "bad fine"), (3, "unseen"), (4, ""), (5, None),
                                   (None, "the rare"), (None, "the")], "id bigint, text string")

    def predicted(model, counts=None):
        return {r.id: pytest.approx([*r.h, *r.m]) for r in textmodel.predict_text_labels(model, asked, "id", "text", counts).collect()}

    def values(found):
        return {i: v.expected for i, v in found.items()}

    small = textmodel.fit_text_labels(train, "text", heads)
    assert small.small
    want = predicted(small)
    monkeypatch.setattr(scaling, "BROADCAST_BYTES", scaling.measured_bytes(small.words.where("token = 'the'").select("token", "weights")) + 1)
    large = textmodel.fit_text_labels(train, "text", heads)
    stored, kept = {}, scaling.written
    monkeypatch.setattr(scaling, "written", lambda df, name: stored.setdefault(name, kept(df, name)))
    assert not large.small
    assert values(predicted(large)) == want
    assert {r.token for r in stored["lookup-side"].collect()} == {"unseen", "rare", "good", "bad", "fine"}
    monkeypatch.setattr(scaling, "written", kept)
    assert values(predicted(large, ranking.term_counts(asked, "id", "text"))) == want
    monkeypatch.setattr(scaling, "BROADCAST_BYTES", 1)
    none = textmodel.fit_text_labels(train, "text", heads)
    assert not none.small and none.least is None
    assert values(predicted(none)) == want


def test_classes_without_training_texts_are_never_predicted(spark):
    train = spark.createDataFrame([(1, "good " * 50, 1), (2, "bad fine", 0)], "id bigint, text string, y int")
    model = textmodel.fit_text_labels(train, "text", [Head("h", "y", 4)])
    asked = spark.createDataFrame([(1, "good rare " * 20), (2, "rare"), (3, None)], "id bigint, text string")
    for r in textmodel.predict_text_labels(model, asked, "id", "text").collect():
        assert max(r.h[2:]) < min(r.h[:2])


def test_class_names_like_summaries(spark):
    rows = [("accuracy", "accuracy"), ("macro avg", "accuracy"), ("x", "x")]
    report = evaluation.classification_report(spark.createDataFrame(rows, "p string, t string"), "p", "t")
    lines = {(r.kind, r["class"]): r.support for r in report.collect()}
    assert lines == {("class", "accuracy"): 2, ("class", "macro avg"): 0, ("class", "x"): 1,
                     ("summary", "accuracy"): 3, ("summary", "macro avg"): 3, ("summary", "weighted avg"): 3}


def test_linear_model_separates(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", i % 2, [i % 2, 1 - i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, tags array<int>")
    heads = [Head("h", "y", 2), Head("m", "tags", 2, multi=True)]
    fitted = linear.fit_text_labels_lr(df, "id", "text", heads)
    scored = linear.predict_text_labels_lr(fitted, df, "id", "text")
    for r in scored.collect():
        assert (r.h[1] > r.h[0]) == bool(r.id % 2) and (r.m[0] > 0) == bool(r.id % 2)


def test_pair_features(spark):
    df = spark.createDataFrame([(1, "total of orders", "order total"), (2, "x", "y")], "id bigint, q string, n string")
    rows = {r.id: r for r in textmodel.pair_features(df, "id", "q", "n").collect()}
    assert (rows[1].shared, rows[1].jaccard, rows[2].idf_share) == (1.0, 0.25, 0.0)
    assert rows[1].idf_share == pytest.approx(0.5)


def test_token_limit(spark):
    df = spark.createDataFrame([(1, "One two THREE"), (2, "")], "id int, t string")
    assert [r.token for r in textmodel.tokens(df, "id", "t").orderBy("pos").collect()] == ["one", "two", "three"]
    assert textmodel.tokens(df, "id", "t", 2).count() == 2


def test_report(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "a")]
    df = spark.createDataFrame(pairs, "t string, p string")
    rep = {r["class"]: r for r in evaluation.classification_report(df, "p", "t").collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["a"].support) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 3)
    assert (rep["c"].precision, rep["c"].f1) == (0.0, 0.0)
    assert rep["accuracy"].f1 == pytest.approx(0.6) and rep["accuracy"].support == 5
    assert rep["macro avg"].recall == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert evaluation.weighted_prf(df, "p", "t").first().recall == pytest.approx(0.6)


def test_sample_f1_zero(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["a"])], "p array<string>, t array<string>")
    assert evaluation.sample_f1(df, {"h": ("p", "t")}).first().value == pytest.approx((0 + 0 + 2 / 3) / 3)


def test_info_nce_padding(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "table string, vec array<double>")
    triplets = spark.createDataFrame(
        [(1, [1.0, 0.0], "a", ["b", "c"]), (2, [1.0, 0.0], None, ["b"]), (3, [0.0, 2.0], "b", [])],
        "query_id bigint, vec array<double>, positive string, negatives array<string>")
    losses = [
        -1 + math.log(math.e + 1 + math.exp(-1)), math.log(3), -1 + math.log(math.e + 2),
    ]
    assert evaluation.info_nce(triplets, vectors, 1.0).first().value == pytest.approx(sum(losses) / 3)


def test_correlation_with_ties(spark):
    pairs = spark.createDataFrame([(0.9, 1.0), (0.1, 0.0), (0.1, 1.0), (0.4, 0.0)], "score double, label double")
    got = {r.metric: r.value for r in evaluation.score_correlation(pairs).collect()}
    ranks, labels = [4, 1.5, 1.5, 3], [3.5, 1.5, 3.5, 1.5]

    def corr(x, y):
        mx, my = sum(x) / 4, sum(y) / 4
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(
            sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))

    assert got["spearman"] == pytest.approx(corr(ranks, labels))
    assert got["pearson"] == pytest.approx(corr([0.9, 0.1, 0.1, 0.4], [1, 0, 1, 0]))


def test_category_beyond_the_list(spark):
    from hintwise.operators.encoding import category_name
    df = spark.createDataFrame([(0,), (5,), (6,)], "i int")
    assert [r[0] for r in df.select(category_name(F.col("i"))).collect()] == ["Data Manipulation", "Procedural SQL", "Category 6"]
