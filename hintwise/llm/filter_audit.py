"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document is known to its part by the set of filters that it fails, so documents are first counted by
part and failed set. Orders are numbered by their lexicographic (Lehmer) rank. The orders in which a
failed set is caught at a given step by a given filter all begin with the same letters, and thus have
consecutive numbers; a count is added where such an interval begins and taken away where it ends, and
running sums over the 120 numbers give what every order removes at every step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from hintwise.llm.common import let, words
from hintwise.operators.scaling import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
COPY = 1 << FILTERS.index("E")
MEASURES = ("removed", "good_lost", "toxic_lost")
# salts for rows without an id, which find no label
NO_ID_SALTS = 4096


def rank(order: str) -> int:
    """Lexicographic rank of a permutation of ``FILTERS``, from its Lehmer code."""
    return sum(
        sum(later < letter for later in order[i + 1:]) * factorial(len(order) - 1 - i) for i, letter in enumerate(order)
    )


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first, after): for each non-empty set of failed filters the ranks, from ``first`` to before
    ``after``, of the orders in which a document is caught at ``step`` (1 to 5).

    Such orders begin with step - 1 filters that the document passes and one that it fails."""
    out = []
    for mask in range(1, 1 << len(FILTERS)):
        failed = [f for i, f in enumerate(FILTERS) if mask >> i & 1]
        passed = [f for f in FILTERS if f not in failed]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for f in failed:
                    start = "".join(before) + f
                    first = rank(start + "".join(x for x in FILTERS if x not in start))
                    out.append((mask, step, first, first + factorial(len(FILTERS) - step)))
    return out


def conditions(text: Column) -> Column:
    """Sum of 1, 2, 4 and 8 for the filters A to D that a text fails."""
    failed = lambda w: (
        F.size(w) < LEAST_WORDS, 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length(text), text.rlike(SYMBOLS),
    )
    return let(words(text), lambda w: sum(
        (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed(w))), F.lit(0)))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters, and how many of them are
    labelled good and toxic.

    Texts are cut into words once; afterwards only a digest of each travels. A document fails E if a smaller
    id has the same text anywhere: digests are counted by part and id first, then reduced to the least id,
    so that the copies of one text meet as one row per part."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.md5(text).alias("h"), conditions(text).alias("mask"))
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.lit(0).cast("long").alias("salt"))
    # rows without an id have no label; the salt keeps them from meeting in one task
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(NO_ID_SALTS))).otherwise(F.lit(0).cast("long"))
    known = marked.withColumn("salt", salt).join(flags, ["doc_id", "salt"], "left").select(
        "doc_id", "part", "h", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    keys = ["h", "part", "mask", "good", "toxic"]
    by_id = known.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    no_id = F.col("doc_id").isNull()
    copies = by_id.groupBy(*keys).agg(
        F.min(F.when(~no_id, F.struct("doc_id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(no_id, F.col("n"))), F.lit(0)).alias("without"), F.sum("n").alias("n"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(W.partitionBy("h"))
    originals = F.col("without") + F.when(first, F.col("least.n")).otherwise(0)
    split = copies.withColumn("originals", originals).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("originals").alias("n")),
        F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))))
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _orders(spark: SparkSession) -> DataFrame:
    rows = [(i, "".join(p), k, p[k - 1]) for i, p in enumerate(permutations(FILTERS)) for k in range(1, len(FILTERS) + 1)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, filter string")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    one row per part, order of the filters and step, zeros included.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are ignored. A null
    source is the part of the empty string; a null text is empty, and fails A only, and E where a smaller id is
    empty too. A null id is never smaller or greater than another, so it neither makes copies nor is one, and it
    has no label. Rows that repeat an id are documents of their own; if labels repeat an id, one mark is enough.
    Texts are compared by md5. An empty table has no parts. Very long texts are read whole.
    """
    spark = docs.sparkSession
    cells = written(failed_sets(docs, labels), "failed-sets")
    steps = spark.createDataFrame(intervals(), "mask int, step int, first int, after int")
    signed = lambda at, sign: F.struct(F.col(at).alias("rank"), *(
        (F.col(c) * sign).alias(m) for c, m in zip(("n", "good", "toxic"), MEASURES)))
    ends = cells.join(F.broadcast(steps), "mask").select("part", "step", F.inline(F.array(signed("first", 1), signed("after", -1))))
    grid = cells.select("part").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    zeros = grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(m) for m in MEASURES))
    changes = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in MEASURES))
    upto = W.partitionBy("part", "step").orderBy("rank")
    removed = changes.select("part", "step", "rank", *(F.sum(m).over(upto).alias(m) for m in MEASURES)).where(
        F.col("rank") < factorial(len(FILTERS)))
    fails = lambda m, i: F.sum(F.when(m(F.col("mask"), 1 << i), F.col("n")).otherwise(0))
    totals = cells.groupBy("part").agg(F.sum("n").alias("n"), *(c for i, f in enumerate(FILTERS) for c in (
        fails(lambda mask, bit: mask.bitwiseAND(bit) > 0, i).alias(f"fails_{f}"),
        fails(lambda mask, bit: mask == bit, i).alias(f"only_{f}"))))
    per_filter = totals.select("part", "n", F.inline(F.array(*(
        F.struct(F.lit(f).alias("filter"), F.col(f"fails_{f}").alias("fails"), F.col(f"only_{f}").alias("unique_fails")) for f in FILTERS))))
    named = removed.join(F.broadcast(_orders(spark)), ["rank", "step"]).join(per_filter, ["part", "filter"])
    so_far = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    return named.select(
        "part", "filter_order", "step", "filter", (F.col("n") - so_far).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"))
