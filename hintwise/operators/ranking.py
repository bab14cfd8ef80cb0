"""Ranking the tables or columns of a catalog for every question."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.functions.text import word_tokens
from hintwise.functions.vectors import cosine
from hintwise.operators.blocks import SCORE_DIGITS, PackedCatalog, pack_catalog, ranked_by_blocks
from hintwise.operators.scaling import dense_positions, lookup_join, short_batches, small_enough, written
from hintwise.schemas import HINTS_TOP_K


def cosine_scores(questions: DataFrame, catalog: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(query_id, table, score)``: cosine of each question with each catalog entry, or of the listed
    ``pairs(query_id, table)`` only, one row for each of them. Ids and names are unique then.

    Listed pairs gather the two vectors by lookups that hot questions and hot entries do not burden; a pair
    whose question or entry is unknown has a null score, and one with a missing vector 0, as in a ranking."""
    if pairs is None:
        return rank_all(questions, catalog).select("query_id", "table", "score")
    known = F.lit(True).alias("_known")
    vector = F.coalesce(F.col("vec").cast("array<double>"), F.array().cast("array<double>"))
    asked = lookup_join(pairs, questions.select("query_id", vector.alias("_q"), known), "query_id", "left")
    met = lookup_join(asked.withColumnRenamed("_known", "_asked"), catalog.select("table", vector.alias("_c"), known), "table", "left")
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cosine(F.col("_q"), F.col("_c")), F.lit(0.0)))), SCORE_DIGITS) + 0.0
    return met.select(*pairs.columns, F.when(F.col("_asked") & F.col("_known"), score).alias("score"))


def scaled_scores(scores: DataFrame) -> DataFrame:
    """Cosines mapped from [-1, 1] to [0, 1]."""
    return scores.withColumn("score", (F.col("score") + 1) / 2)


def rank_all(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """The whole catalog ranked for every question: ``hints(query_id, rank, table, score)``."""
    return ranked_by_blocks(questions, catalog, "query_id", "table", "vec")


def rank_top_k(
    questions: DataFrame, catalog: DataFrame | PackedCatalog, top_k: int = HINTS_TOP_K,
    min_score: float = 0.0,
) -> DataFrame:
    """The ``top_k`` best entries per question, of which those below ``min_score`` are then
    dropped. ``questions(query_id, vec)``, ``catalog(table, vec)`` or the result of
    ``pack_catalog(catalog, "table", "vec")``, which many rankings can share."""
    ranked = ranked_by_blocks(questions, catalog, "query_id", "table", "vec", k=top_k)
    return ranked.where(F.col("score") >= min_score)


def rank_columns(
    questions: DataFrame, columns: DataFrame, top_k: int = HINTS_TOP_K, min_score: float = 0.0
) -> DataFrame:
    """:func:`rank_top_k` over ``columns(table, column, vec)``. An entry is the pair of names, so
    either may hold dots; ties go by table, then column."""
    entries = columns.select(F.struct("table", "column").alias("table"), "vec")
    ranked = rank_top_k(questions, entries, top_k, min_score)
    return ranked.select("query_id", "rank", "table.table", "table.column", "score")


# --- text ------------------------------------------------------------------------------------

def token_document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(token, df, idf)`` over a catalog: in how many entries each word occurs, and
    ln((N + 1) / (df + 1)) + 1. Counts combine before the shuffle, so common words are cheap."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    words = docs.select(key, F.explode_outer(F.array_distinct(word_tokens(F.col(text)))).alias("token"))
    return words.where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "idf", F.log((total + 1) / (F.col("df") + 1)) + 1
    )


# characters of text whose words a task counts, about
PART_CHARS = 1 << 22


def text_parts(texts: DataFrame, text: str) -> int | None:
    """Partitions for counting the words of ``texts``, measured, so that a task holds as much whatever their size;
    None where one would do."""
    chars = texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first().n
    if chars <= PART_CHARS:
        return None
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PART_CHARS))


def term_counts(texts: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """``(key, token, n)``, in ``parts`` partitions if the caller says how many. The texts are dealt out by key before they are cut into words, so
    that the words, many times larger, are counted and later regrouped without an exchange.
    A text without words keeps one row with a null token."""
    return (
        texts.select(key, text).repartition(*([parts] if parts else []), key)
        .select(key, F.explode_outer(word_tokens(F.col(text))).alias("token"))
        .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    )


def fit_vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered words of a catalog with their weights, computed once and reused:
    ``(token, df, idf, term)``."""
    return written(
        dense_positions(token_document_frequency(docs, key, text), "token", "term"), "vocabulary"
    )


def tfidf_vectors(
    texts: DataFrame, key: str, text: str, vocabulary: DataFrame, small: bool | None = None, parts: int | None = None,
) -> DataFrame:
    """``(key, terms, weights)`` with one row per text; words outside the vocabulary are left
    out, as with a vectorizer fitted on the catalog. Texts without a known word keep an empty
    vector."""
    return _weighted_vectors(term_counts(texts, key, text, parts), key, vocabulary, small)


def _weighted_vectors(counts: DataFrame, key: str, vocabulary: DataFrame, small: bool | None, parts: int | None = None) -> DataFrame:
    weighted = lookup_join(
        counts, vocabulary.select("token", "term", "idf"), "token", "left", small=small
    )
    entry = F.when(
        F.col("term").isNotNull(), F.struct("term", (F.col("n") * F.col("idf")).alias("weight"))
    )
    if parts:
        weighted = weighted.repartition(parts, key)
    return weighted.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_v")).select(
        key,
        F.transform("_v", lambda e: e["term"]).alias("terms"),
        F.transform("_v", lambda e: e["weight"]).alias("weights"),
    )


@dataclass(frozen=True)
class TextCatalog:
    """A catalog that is ready to be ranked by text: its vocabulary, whether that was measured to fit
    every executor, and its packed vectors."""

    vocabulary: DataFrame
    small: bool
    packed: PackedCatalog


def fit_catalog(catalog: DataFrame, vocabulary: DataFrame | None = None) -> TextCatalog:
    """Weight and pack ``catalog(table, doc)`` once, for any number of rankings. Its words are
    counted once, for the vocabulary and for the vectors alike."""
    parts = text_parts(catalog, "doc")
    counts = written(term_counts(catalog, "table", "doc", parts), "catalog-terms")
    if vocabulary is None:
        total = catalog.agg(F.count(F.lit(1)).alias("n")).scalar()
        df = counts.where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn(
            "idf", F.log((total + 1) / (F.col("df") + 1)) + 1)
        vocabulary = written(dense_positions(df, "token", "term"), "vocabulary")
    small = small_enough(vocabulary)
    vectors = _weighted_vectors(counts, "table", vocabulary, small, parts)
    return TextCatalog(vocabulary, small, pack_catalog(vectors, "table", "weights", "terms"))


def rank_by_text(
    questions: DataFrame, catalog: DataFrame | TextCatalog, top_k: int = HINTS_TOP_K, min_score: float = 0.0,
    vocabulary: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Rank ``catalog(table, doc)``, or what :func:`fit_catalog` made of it, for
    ``questions(query_id, text)`` by tf-idf cosine. The vocabulary is the catalog's own, unless
    another is given. ``counts`` are the questions' ``term_counts``, if the caller has them."""
    ready = catalog if isinstance(catalog, TextCatalog) else fit_catalog(catalog, vocabulary)
    counts = term_counts(questions, "query_id", "text") if counts is None else counts
    asked = _weighted_vectors(counts, "query_id", ready.vocabulary, ready.small)
    ranked = ranked_by_blocks(
        asked, ready.packed, "query_id", "table", "weights", terms="terms", k=top_k,
        asked_rows=1 if ready.packed.single else questions.count(),
    )
    return ranked.where(F.col("score") >= min_score)


def embed_with(texts: DataFrame, text: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """Add ``vec`` by a user's encoder, a function from a text column to a vector column (for
    example a ``pandas_udf`` that returns ARRAY<FLOAT>). A worker holds few texts at once, however many there are."""
    short_batches(texts.sparkSession)
    return texts.withColumn("vec", encoder(F.col(text)))
