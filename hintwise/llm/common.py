"""Expressions and helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.operators.scaling import short_batches as short_batches

# ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# most rows of a dictionary (one row per source or language) that is sent to every executor
SMALL_ROWS = 100_000
ABSENT = -(1 << 63)


def per_process(name: str, make: Callable):
    """A value that a Python process makes once and keeps from task to task. It is held by the
    pyspark package, as functions that travel by value get new globals with every task."""
    import pyspark

    kept = pyspark.__dict__.setdefault("_hintwise_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def hand_back() -> None:
    """Return freed memory of a Python worker to the system at the end of a task: workers are used again, and what
    they keep counts against the tasks and stages that come after."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order; a null text has none."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return let(F.coalesce(trimmed, F.lit("")), lambda t: F.when(
        t == "", F.array().cast("array<string>")
    ).otherwise(F.split(t, BLANK_RUN)))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def keyed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``_k1`` and ``_k2``, by which results find back to their rows: the id (or a reserved
    number for null) and a hash of the text. What is computed from a text alone is the same for
    equal texts, so repeated rows may share a key."""
    return df.withColumns({
        "_k1": F.coalesce(F.col(id_column).cast("bigint"), F.lit(ABSENT)),
        "_k2": text_hash(F.coalesce(F.col(text_column), F.lit(""))),
    })


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a table has been counted to have no more than ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join to a dictionary with one row per key. It is broadcast when counted to be small, else
    both sides are shuffled and adaptive execution splits hot keys."""
    return big.join(F.broadcast(small) if bounded(small) else small, on, how)


def running_sums(values: Column, block: int = 256) -> Column:
    """Running sums of a short or long integer array: sums of blocks, then within a block."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def sums(a: Column, blocks: Column) -> Column:
        return F.transform(a, lambda _, i: total(F.slice(blocks, 1, (i / block).cast("int"))) + total(
            F.slice(a, (i / block).cast("int") * block + 1, i % block + 1)
        ))

    return let(values.cast("array<bigint>"), lambda a: F.when(F.size(a) == 0, a).otherwise(let(
        F.transform(
            F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")),
            lambda b: total(F.slice(a, b * block + 1, block)),
        ),
        lambda blocks: sums(a, blocks),
    )))
