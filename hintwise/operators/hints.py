"""Views on ranked hints ``(query_id, rank, table, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.operators.scaling import lookup_join


def _ordered(hints: DataFrame) -> DataFrame:
    """One row per question with its hints in rank order; as many as were ranked."""
    return hints.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "table", "score"))).alias("_h")
    )


def hint_names(hints: DataFrame) -> DataFrame:
    return _ordered(hints).select("query_id", F.transform("_h", lambda h: h["table"]).alias("tables"))


def hint_scores(hints: DataFrame) -> DataFrame:
    """Table to score; of two hints with the same name the later one counts."""
    last = hints.groupBy("query_id", "table").agg(F.max_by("score", "rank").alias("score"), F.max("rank").alias("rank"))
    entries = F.sort_array(F.collect_list(F.struct("rank", "table", "score")))
    return last.groupBy("query_id").agg(entries.alias("_e")).select("query_id", F.map_from_entries(
        F.transform("_e", lambda e: F.struct(e["table"], e["score"]))).alias("scores"))


def hints_top(hints: DataFrame, k: int) -> DataFrame:
    return hints.where(F.col("rank") <= k)


def hints_above(hints: DataFrame, threshold: float) -> DataFrame:
    return hints.where(F.col("score") >= threshold)


def hints_boost(hints: DataFrame, base_weight: float = 1.0) -> DataFrame:
    """Add ``boost``: base + score / best score of the question, base alone if that is not
    positive."""
    best = F.max("score").over(W.partitionBy("query_id"))
    share = F.when(best > 0, F.try_divide(F.col("score"), best)).otherwise(F.lit(0.0))
    return hints.withColumn("boost", F.lit(float(base_weight)) + share)


def hints_filter_record(hints: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, record)`` with the JSON of table names, scores and question text."""
    def scores(h: Column) -> Column:
        # of two hints with the same name the later one counts
        last = F.filter(h, lambda x, i: ~F.exists(F.slice(h, i + 2, F.size(h)), lambda later: later["table"] == x["table"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["table"], x["score"])))

    record = F.struct(
        F.transform("_h", lambda x: x["table"]).alias("table_names"), scores(F.col("_h")).alias("scores"),
        F.col("text").alias("query"),
    )
    return _ordered(hints).join(questions.select("query_id", "text"), "query_id").select(
        "query_id", F.to_json(record).alias("record")
    )


def hints_count(hints: DataFrame) -> DataFrame:
    return hints.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def apply_filter(results: DataFrame, hints: DataFrame) -> DataFrame:
    """Keep the rows of ``results(query_id, table, …)`` whose table is among the hints."""
    wanted = hints.select("query_id", "table").distinct()
    return lookup_join(results, wanted, ["query_id", "table"]).select(*results.columns)


def apply_boost(results: DataFrame, hints: DataFrame, relevance: str, base_weight: float = 1.0) -> DataFrame:
    """Multiply ``relevance`` by the boost of the row's table; other tables keep theirs."""
    boosts = hints_boost(hints, base_weight).groupBy("query_id", "table").agg(
        F.max_by("boost", "rank").alias("boost")
    )
    return lookup_join(results, boosts, ["query_id", "table"], "left").withColumn(
        relevance, F.col(relevance) * F.coalesce("boost", F.lit(1.0))
    ).select(*results.columns)
