"""Repeatable sampling and splitting. Rows are chosen by the md5 of a key, so a retried task or
another engine picks the same ones."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hintwise.functions.hashing import md5_number, seeded_md5
from hintwise.operators.scaling import written
from hintwise.schemas import SEED, SPLIT_SHARES

# the functions below run in Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# most rows that each task looks for on its own
FIRST_ROWS = 100_000


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows of a smaller frame.

    A histogram of at most 65,536 counts shows the hash cell in which the n-th row falls. The cells
    below it are kept whole, and only the rows of that one cell are ordered.
    """
    hashed = df.withColumn("_h", seeded_md5(seed, F.col(key))).withColumn(
        "_cell", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    )
    return _first_of_cells(hashed, n, ["_h", key]).drop("_h")


def _first_of_cells(celled: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``_cell`` and then ``order``, which is dropped again: whole cells,
    and the first rows of the cell in which the n-th row falls."""
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    running = counts.select(
        "_cell", (F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")).alias("_before"), "_n"
    )
    # the cell that holds the n-th row; every cell is below it when the frame is small enough
    border = running.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") > n)).agg(
        F.struct(
            F.coalesce(F.max("_cell"), F.lit(-1)).alias("cell"),
            F.coalesce(n - F.max("_before"), F.lit(0)).alias("take"),
        ).alias("border")
    ).first().border
    full = running.where((F.col("_before") + F.col("_n")) <= n).agg(
        F.coalesce(F.max("_cell"), F.lit(-1)).alias("last")
    ).first().last
    below = celled.where(F.col("_cell") <= full)
    rest = celled.where(F.col("_cell") == border.cell).orderBy(*order).limit(int(border["take"]))
    return below.unionByName(rest).drop("_cell")


def split_bucket(key: Column, seed: int = SEED) -> Column:
    return md5_number(seeded_md5(seed, key)) % 1000


def split_train_val_test(
    df: DataFrame, key: str, seed: int = SEED, shares: dict[str, float] = SPLIT_SHARES
) -> DataFrame:
    """Add ``split``; a narrow projection, no shuffle and no counting."""
    bucket = split_bucket(F.col(key), seed)
    train = round(shares["train"] * 1000)
    val = train + round(shares["val"] * 1000)
    return df.withColumn(
        "split", F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test")
    )


def split_report(df: DataFrame) -> DataFrame:
    """Rows and share per split; the window runs over the handful of splits."""
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def _first_of_parts(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Of every partition the first ``n`` rows in key order: the others cannot be among the first ``n`` of all. A task
    holds a few times ``n`` rows."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def cut() -> pa.Table:
            table = pa.Table.from_batches(held)
            order = pc.sort_indices(table.select(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")
            return table.take(order[:n])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 4 * n:
                held = cut().to_batches()
                rows = sum(b.num_rows for b in held)
        if held:
            yield from cut().to_batches()

    return df.mapInArrow(first, df.schema)


def head_subset(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows in key order. A task leaves out what cannot be among them; the rest is dealt out by
    ranges of the keys, and only the range in which the n-th row falls is cut."""
    sortable = all(isinstance(df.schema[k].dataType, T.IntegralType) or df.schema[k].dataType == T.StringType() for k in keys)
    left = written(_first_of_parts(df, n, list(keys)), "first-of-parts") if sortable and n <= FIRST_ROWS else df
    ranged = written(left.repartitionByRange(*keys).withColumn("_cell", F.spark_partition_id()), "key-ranges")
    return _first_of_cells(ranged, n, list(keys))
