"""Column functions on free text.

Arrays made by these functions are unfolded with ``explode_outer`` throughout the package: for
``explode`` the optimizer adds a filter on the array's size, and pushes it down with a second
copy of whatever computes the array.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character that counts as blank when text is stripped
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  "
    "           "
    "    　"
)
WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def count_text(text: Column, piece: str) -> Column:
    """How often ``piece`` occurs in ``text``, words or not."""
    shorter = F.length(F.replace(text, F.lit(piece), F.lit("")))
    return ((F.length(text) - shorter) / len(piece)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row. A column that a lambda captures may
    otherwise be inlined by the optimizer and computed again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_lit(values: list) -> Column:
    """A constant array, built in one call however long it is."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value).lower()

    return F.expr("array(" + ", ".join(literal(v) for v in values) + ")")


def _between_markers(text: Column) -> Column:
    """Text after the first ``prompt:`` up to a second one, then before ``schema:``."""
    after = F.split_part(text, F.lit("prompt:"), F.lit(2))
    return strip(F.split_part(after, F.lit("schema:"), F.lit(1)))


def extract_prompt(text: Column) -> Column:
    """The question in a structured prompt; text without a marker is kept, null gives ''."""
    return (
        F.when(text.isNull(), F.lit(""))
        .when(text.contains("prompt:"), _between_markers(text))
        .otherwise(strip(F.split_part(text, F.lit("schema:"), F.lit(1))))
    )


def extract_prompt_strict(text: Column) -> Column:
    """As :func:`extract_prompt`, but text without a marker gives ''."""
    return F.when(text.contains("prompt:"), _between_markers(text)).otherwise(F.lit(""))


def word_tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-case words in order. ``max_tokens`` truncates as a fixed-length encoder does;
    by default the whole text is used."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)
