"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A labelled log or a pair table as parquet, one folder per split, so that readers of one
    split skip the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_label_dict(label_dict: DataFrame, path: str, mode: str = "errorifexists") -> None:
    label_dict.select("head", "idx", "label").coalesce(1).write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str, run_id: str, mode: str = "append") -> None:
    """``metrics(run_id, head, metric, value)`` as JSON lines."""
    metrics.select(F.lit(run_id).alias("run_id"), "head", "metric", "value").coalesce(1).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV in the dialect that :func:`hintwise.sources.readers.read_csv` reads."""
    (
        df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
