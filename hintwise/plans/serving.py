"""Answering questions in bulk: one job over all requests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.functions.text import let, strip
from hintwise.functions.vectors import l2_normalize
from hintwise.operators import decoding
from hintwise.operators.blocks import SCORE_DIGITS
from hintwise.operators.hints import hint_names
from hintwise.operators.ranking import (
    TextCatalog, fit_vocabulary, rank_by_text, scaled_scores, term_counts, tfidf_vectors,
)
from hintwise.operators.scaling import lookup_join, small_enough, written
from hintwise.operators.textmodel import TextModel, predict_text_labels
from hintwise.schemas import HINTS_TOP_K
from hintwise.sources.readers import parse_catalog_list, split_requests, validate_requests

# requests that a task ranks, about
PART_REQUESTS = 1 << 16


def analyze_batch(
    queries: DataFrame, model: TextModel, catalog: DataFrame | TextCatalog | None = None,
    top_k: int = HINTS_TOP_K, vocabulary: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """One record per question of ``queries(query_id, text)``: labels, confidences and, with a
    ``catalog(table, doc)`` or what ``fit_catalog`` made of it, its ``top_k`` best tables. A blank or null question is answered like
    one without known words: by the models' priors, and by tables in name order. ``counts`` are the questions'
    ``term_counts``, if the caller has them."""
    asked = queries.withColumn("text", F.coalesce("text", F.lit("")))
    if catalog is not None and counts is None:  # the words are counted once, for the labels and for the ranking
        counts = written(term_counts(asked, "query_id", "text"), "question-terms")
    decoded = decoding.decode(predict_text_labels(model, asked, "query_id", "text", counts))
    hints = None
    if catalog is not None:
        hints = scaled_scores(rank_by_text(asked, catalog, top_k, vocabulary=vocabulary, counts=counts))
    return decoding.analysis_record(decoded, asked, hints)


def analyze(
    spark: SparkSession, text: str, model: TextModel, catalog: DataFrame | TextCatalog | None = None,
    top_k: int = HINTS_TOP_K,
) -> DataFrame:
    """:func:`analyze_batch` for a single question, which must not be blank."""
    request = spark.createDataFrame([(0, text)], "query_id bigint, query string")
    valid, rejected = split_requests(request)
    refused = rejected.first()
    if refused is not None:
        raise ValueError(refused.reason)
    return analyze_batch(valid.withColumnRenamed("query", "text"), model, catalog, top_k)


def _sparse_dot(terms: Column, weights: Column, other_terms: Column, other_weights: Column) -> Column:
    """Dot product of two sparse vectors with distinct terms: both are sorted into one list, where equal
    terms are neighbours, so the cost is that of sorting the terms."""
    def entries(t: Column, w: Column) -> Column:
        return F.transform(F.arrays_zip(t.alias("t"), w.alias("w")), lambda e: F.struct(e["t"].alias("t"), e["w"].alias("w")))

    products = let(F.sort_array(F.concat(entries(terms, weights), entries(other_terms, other_weights))), lambda m: F.transform(
        m, lambda x, i: F.when((i > 0) & (F.get(m, i - 1)["t"] == x["t"]), x["w"] * F.get(m, i - 1)["w"]).otherwise(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def rank_requests(requests: DataFrame, top_k: int = 10) -> DataFrame:
    """Rank each request's own list of tables: ``requests(query_id, query, tables)`` with the
    tables as delimited text. A request yields min(top_k, its entries) rows.

    Entry texts are weighted once per distinct entry over all requests; the work grows with the
    total number of entries listed.
    """
    valid = validate_requests(requests).where("reason IS NULL").drop("reason")
    # a task has about as many requests whatever their number
    parts = max(int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(valid.count() / PART_REQUESTS))
    listed = parse_catalog_list(valid, "tables").select("query_id", "entry_pos", "table")
    entries = written(listed.select("table").distinct(), "request-entries").withColumn("doc", F.col("table"))
    vocabulary = fit_vocabulary(entries, "table", "doc")
    entry_vectors = tfidf_vectors(entries, "table", "doc", vocabulary).select(
        "table", F.col("terms").alias("e_terms"), l2_normalize(F.col("weights")).alias("e_weights")
    )
    asked = tfidf_vectors(valid, "query_id", "query", vocabulary, parts=parts).select(
        "query_id", F.col("terms").alias("q_terms"), l2_normalize(F.col("weights")).alias("q_weights")
    )
    # small vectors are looked up after the requests have been dealt, so that the names alone travel and are sorted
    small = small_enough(entry_vectors)
    met = (lookup_join(listed.join(asked, "query_id"), entry_vectors, "table", small=True) if small
           else lookup_join(listed, entry_vectors, "table", small=False).join(asked, "query_id"))
    score = F.round(_sparse_dot(
        F.col("e_terms"), F.col("e_weights"), F.col("q_terms"), F.col("q_weights")
    ), SCORE_DIGITS)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "table", "entry_pos"))
    return (
        met.select("query_id", "entry_pos", "table", score.alias("score"))
        .withColumn("rank", place).where(F.col("rank") <= top_k)
        .select("query_id", "rank", "table", "score")
    )


def label_info(label_dict: DataFrame) -> DataFrame:
    """``(head, labels)``: the classes of every head in code order."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "label")))
    return label_dict.groupBy("head").agg(F.transform(ordered, lambda e: e["label"]).alias("labels"))


def combined_analysis(
    requests: DataFrame, model: TextModel, top_k: int = 10
) -> DataFrame:
    """Analysis of every request, with a ranking where a request with a question lists tables:
    ``requests(query_id, query, tables)``."""
    texts = requests.select("query_id", F.col("query").alias("text"))
    records = analyze_batch(texts, model).drop("tables")
    hints = rank_requests(requests.where(F.coalesce(strip(F.col("tables")), F.lit("")) != ""), top_k)
    return records.join(hint_names(hints), "query_id", "left")


def route_queries(
    records: DataFrame, hints: DataFrame, keep: int = HINTS_TOP_K
) -> DataFrame:
    """``(query_id, complexity, route, tables)``: simple questions go to a template, others to a
    model, each with its best tables."""
    route = F.when(F.col("complexity") == "simple", "template").otherwise("model")
    best = hint_names(hints.where(F.col("rank") <= keep))
    return records.select("query_id", "complexity", route.alias("route")).join(best, "query_id", "left")
