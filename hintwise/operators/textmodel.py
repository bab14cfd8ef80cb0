"""Text to labels, fitted by distributed aggregation.

:func:`fit_text_labels` is a multinomial naive Bayes model for any number of single-label and
multi-label heads at once. Its logits have the layout that :mod:`hintwise.operators.decoding`
reads, one array of logits per head.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit, let, word_tokens
from hintwise.operators.ranking import token_document_frequency
from hintwise.operators.scaling import compute_once, count_level, fitting_level, lookup_join, written


def tokens(texts: DataFrame, key: str, text: str, max_tokens: int | None = None) -> DataFrame:
    """``(key, pos, token)``: words in order, all of them unless ``max_tokens`` is set."""
    words = F.posexplode_outer(word_tokens(F.col(text), max_tokens))
    return texts.select(key, words.alias("pos", "token")).where("token IS NOT NULL")


@dataclass(frozen=True)
class Head:
    """One output. ``column`` holds the class index of a single-label head, or the 0/1 vector
    of a multi-label head; ``size`` is the number of classes."""

    name: str
    column: str
    size: int
    multi: bool = False

    def members(self, offset: int) -> Column:
        """The classes that hold for a row, numbered from ``offset``."""
        if not self.multi:
            return F.array(F.col(self.column) + offset)
        numbered = F.transform(self.column, lambda flag, i: F.when(flag == 1, i + offset))
        return F.coalesce(F.array_compact(numbered), F.array().cast("array<int>"))


@dataclass(frozen=True)
class TextModel:
    """``words(token, weights, count)`` and the one-row ``priors(weights)``; weights are in the order
    of the heads and of their classes. A class without a training text keeps its place, with a
    prior of ``NEVER``, so it is never predicted. ``small`` tells whether the words were measured to fit
    every executor, ``least`` from which level of counts on they do."""

    words: DataFrame
    priors: DataFrame
    heads: tuple[Head, ...]
    small: bool | None = None
    least: int | None = None


# prior of a single-label class that no training text has
NEVER = -1e6
# stands for "any class" in the counts: every word of every text counts once under it
ANY = -1
# stands for "any text" among the words, and counts every text once; no word is empty
TEXT = ""


def fit_text_labels(train: DataFrame, text: str, heads: list[Head]) -> TextModel:
    """Fit all heads from one pass over the training texts.

    Words are counted per list of classes that hold for their text, of which there are few, and
    then per class, combined before the shuffle, so a common word costs as much as a rare one; the texts are counted in the same pass. Multi-label
    tags get the log odds of the tag against its absence. Counts are smoothed by one.
    """
    width = sum(h.size for h in heads)
    members, offset = [F.array(F.lit(ANY))], 0
    for head in heads:
        members.append(head.members(offset))
        offset += head.size
    multi = array_lit([h.multi for h in heads for _ in range(h.size)])
    sizes = array_lit([h.size for h in heads for _ in range(h.size)])
    class_numbers = F.sequence(F.lit(0), F.lit(width - 1))

    entries = F.concat(F.array(F.lit(TEXT)), F.coalesce(
        word_tokens(F.col("_text")), F.array().cast("array<string>")))
    # classes are listed once per text, not again for each of its words
    listed = compute_once(train.select(F.col(text).alias("_text"), *dict.fromkeys(h.column for h in heads)), {
        "_classes": F.array_compact(F.concat(*members))})
    counted = written(
        listed.select(F.explode_outer(entries).alias("token"), F.col("_classes").alias("classes"))
        .groupBy("token", "classes").agg(F.count(F.lit(1)).alias("n"))
        .select("token", F.explode_outer("classes").alias("class"), "n")
        .groupBy("token", "class").agg(F.sum("n").alias("n")),
        "word-counts",
    )

    def dense(counts: str) -> Column:
        """Map of class to count as an array over all classes."""
        return let(F.col(counts), lambda m: F.transform(
            class_numbers, lambda c: F.coalesce(F.try_element_at(m, c), F.lit(0).cast("bigint"))))

    def per_class(counts: DataFrame) -> DataFrame:
        """One row: counts of all classes and of any class."""
        gathered = counts.agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m"))
        return gathered.select(F.struct(dense("m").alias("of"), F.col("m")[ANY].alias("any")).alias("t"))

    def over_classes(counts: Column, weight: Callable[[Column, Column], Column]) -> Column:
        return F.transform(counts, weight).alias("weights")

    is_text = F.col("token") == TEXT
    texts = per_class(counted.where(is_text).select("class", "n"))
    priors = texts.select(over_classes(F.col("t.of"), lambda n, c: F.when(
        F.get(multi, c), F.log((n + 1) / (F.col("t.any") - n + 1))
    ).when(n == 0, F.lit(NEVER)).otherwise(F.log((n + 1) / (F.col("t.any") + F.get(sizes, c))))))

    word_counts = counted.where(~is_text)
    totals = per_class(word_counts.groupBy("class").agg(F.sum("n").alias("n")))
    vocabulary = word_counts.where(F.col("class") == ANY).agg(F.count(F.lit(1)).alias("v"))
    # a group is one word with its classes
    per_word = word_counts.groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m")
    ).withColumns({"t": totals.scalar(), "v": vocabulary.scalar()})
    per_word = compute_once(per_word, {
        "of": dense("m"), "any": F.col("m")[ANY], "total": F.col("t.of"), "all": F.col("t.any"),
    })

    def likelihood(n: Column, c: Column) -> Column:
        share = F.log((n + 1) / (F.get("total", c) + F.col("v")))
        rest = F.log((F.col("any") - n + 1) / (F.col("all") - F.get("total", c) + F.col("v")))
        return F.when(F.get(multi, c), share - rest).otherwise(share)

    words = per_word.select("token", over_classes(F.col("of"), likelihood), F.col("any").alias("count"))
    stored = written(words, "word-weights")
    least = fitting_level(stored, "count")
    return TextModel(stored, written(priors, "priors"), tuple(heads), least == 0, least)


def predict_text_labels(
    model: TextModel, texts: DataFrame, key: str, text: str, counts: DataFrame | None = None,
) -> DataFrame:
    """One array of logits per head. Words that the model has not seen are left out. ``counts`` are
    the texts' ``term_counts``, if the caller has them already."""
    if counts is None:  # sums need no counts: every word is looked up on its own, and the texts stay where they are dealt
        counts = texts.select(key, text).repartition(key).select(
            key, F.explode_outer(word_tokens(F.col(text))).alias("token"), F.lit(1).alias("n"))
    width = sum(h.size for h in model.heads)
    weight = [F.coalesce(F.col("n") * F.get("weights", F.lit(i)), F.lit(0.0)) for i in range(width)]
    added = [F.sum(w).alias(f"s{i}") for i, w in enumerate(weight)]
    words = model.words.select("token", "weights")
    if model.small or model.least is None:
        sums = lookup_join(counts, words, "token", "left", small=model.small).groupBy(key).agg(*added)
    else:
        # the most frequent words, most of any text, are summed where the text is; only the others meet the rest of the model
        often = count_level("count") >= model.least
        met = lookup_join(counts, model.words.where(often).select("token", "weights"), "token", "left", small=True)
        missed = F.when(F.col("weights").isNull(), F.col("token"))
        summed = written(met.groupBy(key, missed.alias("token")).agg(F.sum("n").alias("n"), *added), "text-sums")
        others = lookup_join(
            summed.where("token IS NOT NULL").select(key, "token", "n"), model.words.where(~often).select("token", "weights"),
            "token", "left", small=False)
        sums = summed.where("token IS NULL").drop("token", "n").unionByName(
            others.select(key, *[w.alias(f"s{i}") for i, w in enumerate(weight)])
        ).groupBy(key).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    prior = model.priors.scalar()
    columns, at = [], 0
    for head in model.heads:
        columns.append(F.array(*[
            F.col(f"s{i}") + F.get(prior, F.lit(i)) for i in range(at, at + head.size)
        ]).alias(head.name))
        at += head.size
    return sums.select(key, *columns)


# --- relevance of question/name pairs ---------------------------------------------------------

PAIR_FEATURES = ["shared", "jaccard", "idf_share"]


def pair_features(pairs: DataFrame, key: str, question: str, name: str) -> DataFrame:
    """Shared words, Jaccard overlap and the idf-weighted share of the name's words that the
    question holds. ``key`` is unique per pair."""
    asked = F.array_distinct(word_tokens(F.col(question)))
    named = F.array_distinct(word_tokens(F.col(name)))
    cut = compute_once(pairs, {"_q": asked, "_n": named})
    base = compute_once(cut, {"shared": F.size(F.array_intersect("_q", "_n")).cast("double")}).withColumn(
        "jaccard", F.coalesce(F.try_divide(F.col("shared"), F.size("_q") + F.size("_n") - F.col("shared")), F.lit(0.0)))
    # the pairs are gone through once for their names, however often those are read
    names = written(pairs.select(name).distinct(), "pair-names")
    idf = written(token_document_frequency(names, name, name), "name-idf").select("token", "idf")
    # idf is looked up once per distinct name, of which there are far fewer than pairs
    per_name = lookup_join(
        names.select(name, F.explode_outer(F.array_distinct(word_tokens(F.col(name)))).alias("token"))
        .where("token IS NOT NULL"),
        idf, "token",
    ).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("_idf")).withColumn(
        "_all", F.aggregate("_idf", F.lit(0.0), lambda acc, e: acc + e["idf"]))
    joined = lookup_join(base, written(per_name, "name-words"), name, "left")
    hit = F.aggregate("_idf", F.lit(0.0), lambda acc, e: acc + F.when(F.array_contains("_q", e["token"]), e["idf"]).otherwise(0.0))
    return joined.withColumn(
        "idf_share", F.coalesce(F.try_divide(hit, F.col("_all")), F.lit(0.0))
    ).drop("_q", "_n", "_idf", "_all")
