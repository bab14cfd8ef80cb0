"""Labelling a whole query log in one narrow pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintwise.functions import sql_labels as L
from hintwise.functions.text import strip
from hintwise.operators.scaling import compute_once


def label_query_log(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add keywords, complexity, category, subcategories and table_count.

    One narrow pass, no shuffle: the upper-cased text and the keywords are computed once and
    feed the complexity and the tags.
    """
    text, upper, keywords, held, start = F.col(sql), F.col("_upper"), F.col("keywords"), F.col("_held"), F.col("_start")
    staged = compute_once(
        log.withColumn("_upper", F.upper(text)), {"keywords": L.sql_keywords(text, upper)}
    )
    staged = compute_once(staged, {"_held": L.held_words(keywords), "_start": strip(upper)})
    labelled = compute_once(staged, {
        "complexity": L.sql_complexity(text, keywords, upper, held),
        "category": L.sql_category(text, upper, start),
        "subcategories": L.sql_subcategories(text, keywords, upper, held, start),
        "table_count": L.sql_table_count(text, upper),
    })
    return labelled.drop("_upper", "_held", "_start")


def with_referenced_tables(log: DataFrame, sql: str = "sql") -> DataFrame:
    return compute_once(log, {"tables": L.referenced_tables(F.col(sql))})


def drop_unlabelled(log: DataFrame) -> DataFrame:
    """Keep the queries with at least one referenced table."""
    return log.where(F.size("tables") > 0)
