"""Labels read off the text of a SQL statement, as built-in column expressions.

``sql`` is the statement and ``upper`` its upper-cased form; callers that need several labels
compute ``upper`` once in an earlier projection and hand it in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit, count_text, strip
from hintwise.schemas import (
    AGGREGATES, DEFINING_WORDS, JOINS, NOT_TABLE_NAMES, RIGHTS_WORDS, SET_OPERATORS, SQL_KEYWORDS,
    SUBCATEGORIES, TRANSACTION_WORDS, WINDOW_SIGNS,
)

IDENTIFIER = r"([a-zA-Z_][a-zA-Z0-9_]*)"

PHRASES = [k for k in SQL_KEYWORDS if " " in k]


def held_words(keywords: Column) -> Column:
    """The keywords as one text, in which :func:`_holds` looks them up without taking the array apart."""
    return F.concat(F.lit("|"), F.array_join(keywords, "|"), F.lit("|"))


def _holds(held: Column, *wanted: str) -> Column:
    return _contains_any(held, [f"|{w}|" for w in wanted])


def _contains_any(text: Column, pieces: list[str]) -> Column:
    found = text.contains(pieces[0])
    for piece in pieces[1:]:
        found = found | text.contains(piece)
    return found


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return text.rlike("^(" + "|".join(prefixes) + ")")


def sql_keywords(sql: Column, upper: Column | None = None) -> Column:
    """Keywords that occur as whole words, in declared order; null gives an empty array.

    One split into words answers all single-word keywords at once. Two-word keywords must
    stand with exactly one blank between, so they keep a regex behind a cheap substring test.
    """
    upper = F.upper(sql) if upper is None else upper
    words = F.split(upper, r"(?U)\W+")
    phrases = [
        F.when(upper.contains(p) & upper.rlike(rf"(?U)\b{p}\b"), F.lit(p)) for p in PHRASES
    ]
    nested = F.when(
        sql.contains("(") & (count_text(upper, "SELECT") > 1), F.lit("SUBQUERY")
    )
    found = F.concat(words, F.array(*phrases, nested))
    return F.when(sql.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_intersect(array_lit(SQL_KEYWORDS), found)
    )


def sql_complexity(sql: Column, keywords: Column, upper: Column | None = None, held: Column | None = None) -> Column:
    upper = F.upper(sql) if upper is None else upper
    held = held_words(keywords) if held is None else held
    complex_signs = [
        _holds(held, "SUBQUERY"),
        _holds(held, *SET_OPERATORS),
        count_text(upper, "JOIN") >= 2,
        count_text(upper, "SELECT") > 1,
        _holds(held, "CASE"),
        _holds(held, "HAVING"),
        _contains_any(upper, WINDOW_SIGNS),
    ]
    medium_signs = [
        _holds(held, *JOINS),
        _holds(held, "GROUP BY"),
        _holds(held, *AGGREGATES),
        _holds(held, "ORDER BY"),
        F.size(keywords) > 5,
    ]

    def at_least_two(signs: list[Column]) -> Column:
        return sum((s.cast("int") for s in signs), F.lit(0)) >= 2

    return (
        F.when(sql.isNull(), "simple")
        .when(at_least_two(complex_signs), "complex")
        .when(at_least_two(medium_signs), "medium")
        .otherwise("simple")
    )


def sql_table_count(sql: Column, upper: Column | None = None) -> Column:
    upper = F.upper(sql) if upper is None else upper
    joins = F.regexp_count(upper, F.lit(r"(?U)\bJOIN\b"))
    return F.when(joins >= 2, "3+").when(joins == 1, "2").otherwise("1")


def sql_category(sql: Column, upper: Column | None = None, start: Column | None = None) -> Column:
    upper = F.upper(sql) if upper is None else upper
    start = strip(upper) if start is None else start
    return (
        F.when(_starts_with_any(start, DEFINING_WORDS), "Schema Definition")
        .when(_starts_with_any(start, RIGHTS_WORDS), "Security")
        .when(_starts_with_any(start, TRANSACTION_WORDS), "Transaction Control")
        .when(_contains_any(upper, SET_OPERATORS), "Set Operations")
        .otherwise("Data Manipulation")
    )


def sql_subcategories(
    sql: Column, keywords: Column, upper: Column | None = None, held: Column | None = None, start: Column | None = None,
) -> Column:
    upper = F.upper(sql) if upper is None else upper
    held = held_words(keywords) if held is None else held
    start = strip(upper) if start is None else start
    signs = {
        "Read": start.startswith("SELECT"),
        "Write": _starts_with_any(start, ["INSERT", "UPDATE", "DELETE"]),
        "Aggregation": _holds(held, *AGGREGATES),
        "Filtering": _holds(held, "WHERE"),
        "Sorting": _holds(held, "ORDER BY"),
        "Joining": _holds(held, *JOINS),
        "Grouping": _holds(held, "GROUP BY"),
        "Limiting": _holds(held, "LIMIT", "OFFSET", "DISTINCT"),
        "Subquery": _holds(held, "SUBQUERY"),
        "Windowing": _contains_any(upper, [*WINDOW_SIGNS, "PARTITION BY"]),
        "Set Logic": _holds(held, *SET_OPERATORS),
        "Object DDL": _holds(held, "CREATE", "ALTER", "DROP"),
    }
    # the tags in declared order as one text, which is split once
    tags = F.concat_ws("|", *[F.when(signs[tag], F.lit(tag)) for tag in SUBCATEGORIES if tag in signs])
    return F.split(F.coalesce(F.nullif(tags, F.lit("")), F.lit("Read")), r"\|")


def referenced_tables(sql: Column) -> Column:
    """Names after FROM, JOIN, INTO and UPDATE, lower-cased, distinct and sorted.

    The four words are searched one after another: in ``delete from update x`` one scan for
    all four would swallow ``update`` as a name and miss ``x``.
    """
    names = F.concat(*[
        F.regexp_extract_all(sql, F.lit(rf"(?i)(?U)\b{word}\s+{IDENTIFIER}"), F.lit(1))
        for word in ("FROM", "JOIN", "INTO", "UPDATE")
    ])
    lowered = F.transform(names, lambda n: F.lower(n))
    return F.when(sql.isNull(), F.array().cast("array<string>")).otherwise(
        F.sort_array(F.array_except(lowered, array_lit(NOT_TABLE_NAMES)))
    )
