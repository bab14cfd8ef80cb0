"""Repeatable pseudo-random numbers from md5, the same on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def md5_number(digest: Column) -> Column:
    """The first 32 bits of an md5 digest as a BIGINT."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
