"""From model scores to labels. One row holds one array of logits per head; the long layout
``logits(query_id, head, class_idx, logit)`` is gathered into it first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit
from hintwise.functions.vectors import argmax, sigmoid, softmax
from hintwise.operators.encoding import category_name
from hintwise.schemas import (
    COMPLEXITY_LABELS, LABEL_THRESHOLD, SQL_KEYWORDS, SUBCATEGORIES, TABLE_COUNT_LABELS,
)

HEADS = ["complexity", "category", "table_count", "keywords", "subcategory"]


def gather_logits(logits: DataFrame, heads: list[str] = HEADS) -> DataFrame:
    """Long to wide: one array per head, in class order. A group is one question's classes."""
    def of(head: str) -> Column:
        entries = F.collect_list(F.when(F.col("head") == head, F.struct("class_idx", "logit")))
        return F.transform(F.sort_array(entries), lambda e: e["logit"]).alias(head)

    return logits.groupBy("query_id").agg(*[of(h) for h in heads])


def spread_logits(wide: DataFrame, heads: list[str]) -> DataFrame:
    """Wide to long."""
    def of(head: str) -> Column:
        return F.transform(head, lambda x, i: F.struct(
            F.lit(head).alias("head"), i.alias("class_idx"), x.alias("logit")))

    long = F.explode_outer(F.concat(*[of(h) for h in heads]))
    return wide.select("query_id", long.alias("e")).select("query_id", "e.*")


def softmax_argmax(logits: Column) -> Column:
    """Best class (0-based, the lower one on ties) and its softmax probability."""
    best = argmax(logits)
    return F.struct(best.alias("idx"), F.get(softmax(logits), best).alias("confidence"))


def sigmoid_threshold(logits: Column, classes: list[str], threshold: float = LABEL_THRESHOLD) -> Column:
    """Labels whose sigmoid exceeds the threshold, in declared order."""
    pairs = F.arrays_zip(logits.alias("logit"), array_lit(classes).alias("label"))
    return F.transform(
        F.filter(pairs, lambda p: sigmoid(p["logit"]) > threshold), lambda p: p["label"]
    )


def fallback_label(labels: Column, logits: Column, classes: list[str]) -> Column:
    """The single best label where no label passed the threshold."""
    best = F.get(array_lit(classes), argmax(logits))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(best))


def decode(wide: DataFrame) -> DataFrame:
    """Replace the five logit arrays of a row by labels and confidences."""
    staged = wide.withColumns({
        "_complexity": softmax_argmax(F.col("complexity")),
        "_category": softmax_argmax(F.col("category")),
        "_table_count": softmax_argmax(F.col("table_count")),
        "_tags": sigmoid_threshold(F.col("subcategory"), SUBCATEGORIES),
    })
    return staged.select(
        "query_id",
        F.get(array_lit(COMPLEXITY_LABELS), F.col("_complexity.idx")).alias("complexity"),
        F.col("_complexity.confidence").alias("complexity_confidence"),
        sigmoid_threshold(F.col("keywords"), SQL_KEYWORDS).alias("keywords"),
        category_name(F.col("_category.idx")).alias("category"),
        F.col("_category.confidence").alias("category_confidence"),
        fallback_label(F.col("_tags"), F.col("subcategory"), SUBCATEGORIES).alias("subcategories"),
        F.get(array_lit(TABLE_COUNT_LABELS), F.col("_table_count.idx")).alias("estimated_tables"),
        F.col("_table_count.confidence").alias("table_count_confidence"),
    )


def analysis_record(decoded: DataFrame, questions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One record per question, with its ranked tables when there are hints, else null."""
    records = questions.select("query_id", F.col("text").alias("query")).join(decoded, "query_id")
    if hints is None:
        nothing = F.lit(None).cast("array<struct<table:string,confidence:double>>")
        return records.withColumn("tables", nothing)
    ranked = hints.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "table", "score"))).alias("_h")
    )
    tables = F.transform("_h", lambda h: F.struct(h["table"].alias("table"), h["score"].alias("confidence")))
    return records.join(ranked, "query_id", "left").withColumn("tables", tables).drop("_h")
