"""Distribution reports. All counts combine before the shuffle, so hot values cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, value, n)`` for several columns from one scan."""
    values = F.explode_outer(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return (
        df.select(values.alias("v")).groupBy("v.feature", "v.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("feature", F.desc("n"), "value")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent elements of an array column."""
    return (
        df.select(F.explode_outer(column).alias("value")).where("value IS NOT NULL").groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value").limit(n)
    )


def top_keywords(labelled: DataFrame, n: int = 10) -> DataFrame:
    return top_values(labelled, "keywords", n).withColumnRenamed("value", "keyword")


def pair_balance(pairs: DataFrame) -> DataFrame:
    positive = F.count_if(F.col("label") > 0.5)
    return pairs.agg(
        positive.alias("positive"), (F.count(F.lit(1)) - positive).alias("negative")
    )


def table_vocabulary(log: DataFrame) -> DataFrame:
    """Distinct referenced tables."""
    return log.select(F.explode_outer("tables").alias("table")).where("table IS NOT NULL").distinct()


def ranking_corpus_stats(log: DataFrame, sample: int = 10) -> DataFrame:
    """Queries, distinct tables and the first few table names, in one row."""
    vocabulary = table_vocabulary(log)
    first = vocabulary.orderBy("table").limit(sample).agg(
        F.array_join(F.sort_array(F.collect_list("table")), ",").alias("t")
    )
    tables = vocabulary.agg(F.count(F.lit(1)).alias("n"))
    return log.agg(F.count(F.lit(1)).alias("queries")).select(
        "queries", tables.scalar().alias("tables"), first.scalar().alias("first_tables")
    )
