"""Shared building blocks that keep skewed keys and global numbering off a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# share of all rows above which a join key is treated as hot; fewer than 1 / share keys can be
HOT_SHARE = 0.001
# largest table (in bytes, measured) that is sent to every executor
BROADCAST_BYTES = 32 * 1024 * 1024
NUMBERING_BUCKETS = 4096
# rows of a lookup by shuffle that a task joins, about
LOOKUP_ROWS = 1 << 18


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path of the cluster's shared checkpoint folder. Only a local session,
    whose one machine runs everything, may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = f"{tempfile.gettempdir()}/spark-checkpoints"
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/hintwise/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_folders: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the tables that :func:`written` wrote since entering: for streams and
    long sessions, around work whose results have been stored elsewhere."""
    _folders.append([])
    try:
        yield
    finally:
        for folder in _folders.pop():
            deleted(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss
    of executors, and lets several consumers share one computation."""
    path = shared_folder(df.sparkSession, name)
    for folders in _folders[-1:]:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have ``rows`` rows at most in this session: the default of 10,000 texts is
    tens of megabytes, held several times over by each worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def small_batches(spark: SparkSession, size: int) -> None:
    """Let Arrow batches have ``size`` bytes or one row in this session: rows may be megabytes, and
    a batch would else be all of a task's."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= size:
        spark.conf.set(name, str(size))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection of a costly expression is copied into every filter that is pushed below
    it and into every expression that is merged with it. The output of a generator is not, so
    the columns are unfolded from an array with one struct.
    """
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(struct)))


def hot_keys(df: DataFrame, key: str | list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows: at most 1/share of them, by counting."""
    keys = [key] if isinstance(key, str) else key
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.where(F.col("_n") >= F.greatest(total.scalar() * share, F.lit(2))).select(*keys)


def measured_bytes(df: DataFrame) -> int:
    """Size of a table in its JSON text form: an upper bound of what its values take up, found
    by one distributed aggregate."""
    size = df.select(F.length(F.to_json(F.struct(*df.columns))).alias("bytes"))
    return size.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().bytes


def small_enough(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a table has been measured to be small enough to sit in every executor."""
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def count_level(count: str | Column) -> Column:
    """Level of a count of 1 or more: four for each doubling."""
    return F.floor(4 * F.log2(count)).cast("int")


def fitting_level(dictionary: DataFrame, count: str, limit: int | None = None) -> int | None:
    """The least :func:`count_level` from which on all entries together have been measured to be small enough to sit in every
    executor: 0 if the whole dictionary is, None if not even its most frequent entries are."""
    limit = BROADCAST_BYTES if limit is None else limit
    size = F.length(F.to_json(F.struct(*[c for c in dictionary.columns if c != count])))
    sizes = dictionary.groupBy(count_level(count).alias("level")).agg(F.sum(size).alias("bytes")).collect()
    least, total = None, 0
    for row in sorted(sizes, key=lambda r: -r.level):
        total += row.bytes
        if total > limit:
            return least
        least = row.level
    return 0


def lookup_join(
    big: DataFrame, dictionary: DataFrame, key: str | list[str], how: str = "inner",
    limit: int | None = None, small: bool | None = None,
) -> DataFrame:
    """Join ``big`` to a dictionary with one row per key, safe against hot keys.

    A dictionary measured to be small is broadcast. Beyond that, the rows of hot keys meet only
    the dictionary entries of the hot keys (at most 1/HOT_SHARE rows, so that side can be
    broadcast), and the other rows take a shuffle join in which no key holds more than
    HOT_SHARE of the rows. Callers that have measured the dictionary before pass ``small``.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if small_enough(dictionary, limit) if small is None else small:
        return big.join(F.broadcast(dictionary), key, how)
    big = written(big, "lookup-side")
    parts = -(-big.count() // LOOKUP_ROWS)
    hot = F.broadcast(written(hot_keys(big, key), "hot-keys"))
    # a null key finds nothing; such rows stay where they are, and never meet in one task
    keys = [key] if isinstance(key, str) else key
    nowhere = reduce(or_, [F.col(k).isNull() for k in keys])
    unmatched = big.where(nowhere)
    big = big.where(~nowhere)
    from_hot = big.join(hot, key, "left_semi").join(
        F.broadcast(dictionary.join(hot, key, "left_semi")), key, how
    )
    cold = big.join(hot, key, "left_anti")
    if parts > int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        cold = cold.repartition(parts, *keys)
    from_cold = cold.join(dictionary, key, how)
    found = from_hot.unionByName(from_cold)
    return found if how == "inner" else found.unionByName(unmatched, allowMissingColumns=True)


def by_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """Deal rows out by ranges of their sort order and add the number of the range, ``_b``, which grows
    with the order. Equal rows share a range. The rows are written, so that numbers stay what they are; ranges
    are found from a sample by Spark, and no row is compared with their limits by an expression."""
    return written(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")


def dense_positions(keys: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Add ``name``: the distinct keys numbered 0..n-1, without sorting them in one task.

    Keys are dealt to buckets by md5, numbered inside their bucket, and shifted by the
    number of keys in earlier buckets (a table of at most ``NUMBERING_BUCKETS`` rows). The keys
    are read twice and therefore written out first.
    """
    bucketed = written(keys, "keys").select(
        "*", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 3), 16, 10).cast("int").alias("_b")
    )
    offsets = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before")
    )
    inside = F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    return (
        bucketed.withColumn("_i", inside)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, (F.col("_before") + F.col("_i")).cast("bigint"))
        .drop("_b", "_i", "_before")
    )


def average_ranks(values: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Average rank (1-based) of every distinct value of a numeric column. A row counts once,
    or as often as its ``weight`` says.

    Values are first reduced to distinct values with counts, which takes out any hot value.
    The distinct values are dealt out by ranges; ranks run inside a range and are shifted by the rows in
    the ranges below it (one number per range), so no task sees the whole column.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(times.alias("_n"))
    ranged = by_ranges(counts, value)
    offsets = ranged.groupBy("_b").agg(F.sum("_n").alias("_rows")).select(
        "_b", (F.sum("_rows").over(W.orderBy("_b")) - F.col("_rows")).alias("_before")
    )
    upto = F.sum("_n").over(W.partitionBy("_b").orderBy(value))
    return (
        ranged.withColumn("_upto", upto)
        .join(F.broadcast(offsets), "_b")
        .select(
            value,
            (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"),
        )
    )
