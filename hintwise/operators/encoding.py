"""Label encoding: classes to codes and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit, let
from hintwise.operators.scaling import by_ranges, lookup_join
from hintwise.schemas import CATEGORIES


def fit_label_dict(df: DataFrame, heads: dict[str, str]) -> DataFrame:
    """``label_dict(head, idx, label)``: position among the sorted labels that occur.

    ``heads`` maps head names to columns. All heads are fitted in one pass. The distinct classes are dealt
    out by ranges of (head, label); a window numbers those of a range, and each head is shifted by what
    it has in the ranges before, so a head of millions of classes is numbered by many tasks. Write the result
    out before using it several times.
    """
    entries = F.explode_outer(F.array(*[
        F.struct(F.lit(h).alias("head"), F.col(c).cast("string").alias("label"))
        for h, c in heads.items()
    ]))
    classes = df.select(entries.alias("e")).select("e.head", "e.label").where("label IS NOT NULL").distinct()
    dealt = by_ranges(classes, "head", "label")
    # one row per head and range that holds some of it: no more than heads and ranges together
    counts = dealt.groupBy("head", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("head", "_b", (F.sum("_n").over(W.partitionBy("head").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_b", "head").orderBy("label")) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(before), ["head", "_b"]).select(
        "head", (F.col("_before") + F.col("_i")).cast("int").alias("idx"), "label")


def index_labels(df: DataFrame, head: str, column: str, label_dict: DataFrame) -> DataFrame:
    """Add ``<head>_idx``; labels outside the dictionary get null."""
    codes = label_dict.where(F.col("head") == head).select(
        F.col("label").alias(column), F.col("idx").alias(f"{head}_idx")
    )
    return lookup_join(df, codes, column, "left")


def multi_hot(tags: Column, classes: list[str]) -> Column:
    """Array of tags to a 0/1 vector in declared class order; unknown tags are ignored."""
    return let(tags, lambda held: F.transform(
        array_lit(classes), lambda c: F.array_contains(held, c).cast("int")
    ))


def decode_index(df: DataFrame, head: str, idx: str, label_dict: DataFrame, label: str) -> DataFrame:
    """Code to label by a join with the dictionary."""
    names = label_dict.where(F.col("head") == head).select(
        F.col("idx").alias(idx), F.col("label").alias(label)
    )
    return lookup_join(df, names, idx, "left")


def category_name(idx: Column) -> Column:
    """Code to declared category; codes beyond the list read ``Category <code>``."""
    return F.coalesce(F.get(array_lit(CATEGORIES), idx), F.concat(F.lit("Category "), idx.cast("string")))


def decode_multi_hot(flags: Column, classes: list[str]) -> Column:
    """0/1 vector to the tags that are set, in declared order."""
    pairs = F.arrays_zip(flags.alias("flag"), array_lit(classes).alias("label"))
    return F.transform(F.filter(pairs, lambda p: p["flag"] == 1), lambda p: p["label"])


def label_shapes(df: DataFrame, heads: dict[str, str], declared: dict[str, list[str]]) -> DataFrame:
    """Rows and classes per head: classes seen for single-label heads, declared for the others."""
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.countDistinct(c).alias(h) for h, c in heads.items()],
    )
    entries = [F.struct(F.lit(h).alias("head"), F.col(h).alias("classes")) for h in heads] + [
        F.struct(F.lit(h).alias("head"), F.lit(len(c)).cast("bigint").alias("classes"))
        for h, c in declared.items()
    ]
    return seen.select("rows", F.explode_outer(F.array(*entries)).alias("e")).select("e.head", "rows", "e.classes")
