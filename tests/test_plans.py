"""What the physical plans must and must not contain."""

import pytest

from hintwise.operators import blocks, ranking
from hintwise.plans import registry
from hintwise.plans.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_query_log", "usable_qa_rows", "column_pairs", "split_train_val_test", "softmax_argmax"])
def test_narrow_jobs(spark, sf, name):
    """No Python, no exchange but the one that deals a tiny scan out to all cores."""
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "ArrowEval" not in text
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("name", [
    "value_counts", "catalog_docs", "table_negatives", "rank_top_k", "rank_by_text", "predict_text_labels",
    "info_nce", "recall_at_k", "apply_hints", "rank_request",
])
def test_no_nested_loops(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pruned_scan(spark, sf):
    text = plan(QUERIES["sql_category"](spark, sf))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_small_catalog_needs_no_shuffle(spark, sf):
    text = plan(registry.top_hints(spark, sf))
    asking = text[:text.index("Subquery")]
    assert "Join" not in text and "Window" not in text and "Exchange" not in asking


def test_large_catalog_keeps_k_per_block(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "PACK_ROWS", 64)
    questions, _ = registry.vectors(spark, sf)
    catalog = questions.selectExpr("cast(query_id as string) AS table", "vec")
    text = plan(ranking.rank_top_k(questions, catalog, 3))
    assert "WindowGroupLimit" in text and "NestedLoop" not in text


def test_counts_combine_before_the_shuffle(spark, sf):
    text = plan(QUERIES["value_counts"](spark, sf))
    assert "partial_count" in text
