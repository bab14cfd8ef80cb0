"""Steps over every row of a log or corpus run as compiled code, and give what their rules say."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hintwise.operators import pairs, sampling
from hintwise.operators.labelling import label_query_log


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_and_labels_are_free_of_lambdas(spark):
    raw = spark.createDataFrame([("1", "abcde", "t", "s")], "row_id string, question string, table string, sql string")
    assert "lambda" not in plan(pairs.usable_qa_rows(pairs.with_qa_columns(pairs.filter_questions(raw))))
    labelled = plan(label_query_log(raw))
    assert "lambda" not in labelled
    # tags are put together once per row, and only handed on afterwards
    assert labelled.count("Object DDL") == 1


@pytest.mark.parametrize("text, expected", [
    ("1, 2", [1, 2]), ("", []), (" ", []), (",", []), ("1,,2", [1, 2]), ("1., 2", []), ("+3,-4", [3, -4]),
    (" 7 ,\x0b8", [7, 8]), ("99999999999999999999", []), ("1 2", []), ("5\n", [5]), (", 6 ,", [6]), ("a", []),
])
def test_condition_lists(spark, text, expected):
    df = spark.createDataFrame([(f"'column_index': array([{text}])",)], "sql string")
    assert df.select(pairs.condition_columns(F.col("sql"))).first()[0] == expected


def test_headers_and_indexes_of_odd_rows(spark):
    names = ["a", "ab", ":x", "x" * 49, "y" * 50, "", "\U0001d11ez"]
    table = "{'header': array([" + ", ".join(f"'{n}'" for n in names) + "], dtype=object)}"
    df = spark.createDataFrame([(table,), (None,), ("none",)], "table string")
    found = [r[0] for r in df.select(pairs.extract_headers(F.col("table"))).collect()]
    assert found[1:] == [[], []] and found[0][:2] == ["ab", "x" * 49]
    rows = spark.createDataFrame(
        [(["a", "b"], 1, [0, 5, 1, -1]), ([], 0, [0]), (["a"], None, []), (["a"], 0, None)], "h array<string>, s bigint, c array<bigint>")
    got = [r[0] for r in rows.select(pairs.relevant_indices(F.col("h"), F.col("s"), F.col("c"))).collect()]
    assert got == [[0, 1], [], [], None]


def test_first_rows_leave_their_tasks_alone(spark):
    rows = [(f"k{i % 997:04d}" if i % 50 else None, i % 7, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, p int, v int").repartition(6)
    found = sampling.head_subset(df, 900, "k", "p")
    expected = sorted(((r[0] is not None, r[0] or "", r[1]) for r in rows))[:900]
    assert sorted((r.k is not None, r.k or "", r.p) for r in found.collect()) == expected
    assert sampling._first_of_parts(df, 100, ["k", "p"]).count() == 600


def test_classes_are_listed_once_per_text(spark):
    from hintwise.operators import textmodel

    df = spark.createDataFrame([("a b a", 1, "x"), (None, 0, "y"), ("b", None, "x")], "words string, y int, class string")
    heads = [textmodel.Head("y", "y", 2)]
    rows = {r.token: r.weights for r in textmodel.fit_text_labels(df, "words", heads).words.collect()}
    assert set(rows) == {"a", "b"} and all(len(w) == 2 for w in rows.values())


def test_names_of_pairs_are_read_once(spark, monkeypatch):
    from hintwise.operators import textmodel

    taken = []
    monkeypatch.setattr(textmodel, "written", lambda df, name, real=textmodel.written: taken.append(name) or real(df, name))
    df = spark.createDataFrame(
        [(1, "red blue red", "Blue green"), (2, None, "red"), (3, "red", None), (4, "!", "!")], "k int, q string, n string")
    found = {r.k: (r.shared, r.jaccard, r.idf_share) for r in textmodel.pair_features(df, "k", "q", "n").collect()}
    assert taken[0] == "pair-names" and found[1][:2] == (1.0, 1 / 3) and 0.4 < found[1][2] < 0.6
    assert found[4] == (0.0, 0.0, 0.0) and found[2][1:] == (0.0, 0.0) and found[3][1:] == (0.0, 0.0)


def test_encoders_get_short_batches(spark):
    from hintwise.operators import ranking

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    ranking.embed_with(spark.createDataFrame([("a",)], "t string"), "t", lambda c: F.array(F.length(c)))
    assert int(spark.conf.get(name)) <= 1000
