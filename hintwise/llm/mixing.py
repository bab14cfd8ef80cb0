"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash. A source's mix is made of all documents so many times, plus
those whose hash lies below a threshold. The threshold is found from histograms of tokens by
source and hash bucket: cumulated bucket sums show in which bucket the budget ends, only the rows
of that bucket are cut again by the next bits of their hash, and so on until a bucket holds one
hash. Nothing is sorted but bucket totals, and a larger budget always keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.llm.common import SMALL_ROWS, bounded, n_words
from hintwise.operators.scaling import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
HASH_BITS = 60
LEVEL_BITS = 12


def document_hash(id_column: Column) -> Column:
    """60 bits of the md5 of the id; a null id hashes like an empty string."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join rows to a table with one row per source; a null source is a source of its own. Counted
    to be small the table is broadcast, so a hot source needs no shuffle."""
    key = left["source"].eqNullSafe(right["_source"])
    return left.join(F.broadcast(right) if bounded(right, SMALL_ROWS) else right, key).drop("_source")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """Target tokens per source: ``share`` of all tokens dealt by weight, none above ``most`` times
    what the source has; what is cut off is dealt again by weight.

    ``sizes`` has (source, source_size), one row per source. Weights go round in code point order
    of the names, null last. The fixed point has target = min(cap, weight * level): sources reach
    their caps in order of cap / weight, so the level follows from cumulated caps and weights.
    The windows run over one row per source.
    """
    name = F.col("source")
    numbered = sizes.withColumn("_n", F.row_number().over(W.orderBy(name.isNull(), name)) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    capped = numbered.select(
        "source", "source_size", weight.cast("double").alias("_w"),
        (F.col("source_size") * F.lit(float(most))).alias("_cap"),
    )
    everything = W.partitionBy()
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    levels = capped.select(
        "*",
        (
            (F.sum("source_size").over(everything) * F.lit(float(share))
             - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        ).alias("_level"),
    )
    # the first source in that order that stays below its cap sets the level for all after it
    free = F.when(F.col("_w") * F.col("_level") <= F.col("_cap"), F.col("_level"))
    return levels.select(
        "source", "source_size",
        F.least(
            F.col("_cap"), F.coalesce(F.first(free, ignorenulls=True).over(
                order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.col("_w"), F.col("_cap"))
        ).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For (source, budget): the hash below which ``rows`` (source, hash, size) come nearest to it.

    Returns (_source, threshold): rows with hash < threshold are taken. Documents with one hash
    are taken together; the last hash is taken if that comes nearer to the budget.
    """
    # per source: the prefix of the bucket in which the budget ends, and what lies below it
    state = budgets.select(
        F.col("source").alias("_source"), F.lit(0).cast("bigint").alias("_prefix"), F.col("budget").alias("_left")
    )
    for level in range(HASH_BITS // LEVEL_BITS):
        bits_left = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = _by_source(rows, state).where(
            F.shiftright("hash", bits_left + LEVEL_BITS) == F.col("_prefix")
        ) if level else _by_source(rows, state)
        cells = inside.groupBy("source", F.shiftright("hash", bits_left).alias("_cell"), "_left").agg(
            F.sum("size").alias("_size"), F.min("hash").alias("_low"), F.max("hash").alias("_high")
        )
        upto = F.sum("_size").over(W.partitionBy("source").orderBy("_cell"))
        ends = cells.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_left")).groupBy("source").agg(
            F.min_by(F.struct("_cell", "_size", "_upto", "_left", "_low", "_high"), "_cell").alias("c")
        )
        left = F.col("c._left") - (F.col("c._upto") - F.col("c._size"))
        found = written(ends.select(
            F.col("source").alias("_source"), F.col("c._cell").alias("_prefix"), left.alias("_left"),
            F.when(F.col("c._low") == F.col("c._high"), F.col("c._low") + F.when(
                F.col("c._size") - left <= left, 1
            ).otherwise(0)).alias("_threshold"),
        ), "mix-level")
        # a source without an end has room for all its rows; it leaves with the highest threshold
        state = found.drop("_threshold")
        settled = found if level == 0 else found.unionByName(settled.where("_threshold IS NOT NULL"))
        open_rows = found.where("_threshold IS NULL")
        if open_rows.isEmpty():
            break
        state = open_rows.drop("_threshold")
    return budgets.select(F.col("source").alias("_name")).join(
        settled, F.col("_name").eqNullSafe(F.col("_source")), "left"
    ).select(F.col("_name").alias("_source"), F.coalesce(
        "_threshold", F.lit(1 << HASH_BITS)).cast("bigint").alias("threshold"))


def mixing_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, source, hash, size) and, per source, what decides about its rows:
    (_source, source_size, target, whole, threshold)."""
    sized = written(docs.select(
        F.col("doc_id"), F.col("source"), document_hash(F.col("doc_id")).alias("hash"),
        n_words(F.col("text")).alias("size"),
    ), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(source_targets(sources, weights, share, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    below = thresholds(
        sized.where("size > 0"), plan.where("budget > 0 AND source_size > 0").select("source", "budget")
    )
    return sized, written(plan.join(below, plan["source"].eqNullSafe(below["_source"]), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "whole",
        F.coalesce("threshold", F.lit(0)).alias("threshold"),
    ), "mix-thresholds")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, **options) -> DataFrame:
    """How often each document enters the mix: (doc_id, source, size, source_size, target, copies,
    taken), one row per input row.

    Null texts and texts without words have size 0 and are copied like others of their hash; they
    do not count. A null source is a source of its own, the last. Rows with one doc_id (nulls too)
    share a hash and are taken together. An empty table gives an empty mix. Other columns are
    ignored, whatever their names.
    """
    sized, plan = mixing_plan(docs, **options)
    return _by_source(sized, plan).select(
        "doc_id", "source", "size", "source_size", "target", _copies().alias("copies"),
        (_copies() * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns."""
    _, plan = mixing_plan(docs, **options)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source",
        document_hash(F.col("doc_id")).alias("hash"),
    )
    chosen = _by_source(rows, plan).where(_copies() > 0)
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), _copies()))).select("_row.*")
