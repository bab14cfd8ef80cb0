"""Mining positive and negative pairs.

Everything that concerns one question stays inside its row (array functions), so the pair
tables are produced without a shuffle whatever the number of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.functions.hashing import md5_number, seeded_md5
from hintwise.functions.text import BLANKS, let, strip
from hintwise.operators.scaling import compute_once, dense_positions, lookup_join, small_enough, written
from hintwise.schemas import (
    CONDITION_COLUMNS, HEADER_BLOCK, HEADER_NAME, NUM_NEGATIVES, SEED, SELECTED_COLUMN,
)

MIN_QUESTION = 5
PLAIN_NUMBERS = r"^ *+[0-9]{1,18}+(?:, *+[0-9]{1,18}+)*+\z"
# what stands between two numbers of a list, empty places included
COMMAS = rf"[{BLANKS}]*,[{BLANKS},]*"
# largest vocabulary (measured bytes) that is searched inside a row
IN_ROW_BYTES = 64 * 1024


# --- question/column corpus ---------------------------------------------------------------

def filter_questions(df: DataFrame) -> DataFrame:
    """Keep rows whose stripped question has at least five characters."""
    return compute_once(df, {"question": strip(F.col("question"))}).select(*df.columns).where(
        F.length("question") >= MIN_QUESTION
    )


def extract_headers(table: Column) -> Column:
    """Column names from the printed form ``'header': array(['a', 'b'], dtype=…``.

    Names of one character, of 50 and more, and those that start with a colon are dropped,
    which shifts the positions of the names behind them.
    """
    block = F.regexp_extract(table, HEADER_BLOCK, 1)
    # every quoted name is matched; one that is dropped leaves the group empty
    names = F.regexp_extract_all(block, F.lit(HEADER_NAME), F.lit(1))
    return F.coalesce(F.array_remove(names, ""), F.array().cast("array<string>"))


def selected_column(sql: Column) -> Column:
    """The number behind ``'sel':``, or null."""
    return F.regexp_extract(sql, SELECTED_COLUMN, 1).try_cast("bigint")


def condition_columns(sql: Column) -> Column:
    """The numbers in ``'column_index': array([…])``; one that does not parse empties the list."""
    return _numbers_of(F.regexp_extract(sql, CONDITION_COLUMNS, 1))


def _numbers_of(inner: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    pieces = F.btrim(F.regexp_replace(inner, COMMAS, ","), F.lit(BLANKS + ","))
    numbers = F.split(pieces, ",").try_cast("array<bigint>")
    # a piece that does not parse is a null among the numbers
    parsed = F.size(F.array_distinct(numbers)) == F.size(F.array_except(numbers, F.array(F.lit(None).cast("bigint"))))
    # plain numbers, the usual case, are cast at once
    return F.when(inner == "", empty).when(
        inner.rlike(PLAIN_NUMBERS), F.split(inner, ",").cast("array<bigint>")
    ).when((pieces != "") & parsed, numbers).otherwise(empty)


def relevant_indices(headers: Column, sel: Column, conds: Column) -> Column:
    """Distinct indexes among the selected and the condition columns that point into the
    headers. Negative indexes are refused rather than counted from the end."""
    inside = F.array_intersect(
        F.sequence(F.lit(0).cast("bigint"), (F.size(headers) - 1).cast("bigint")), F.concat(F.array(sel), conds))
    return F.when(F.size(headers) > 0, inside.cast("array<int>")).when(conds.isNotNull(), F.array().cast("array<int>"))


def with_qa_columns(df: DataFrame) -> DataFrame:
    """Parse the printed ``table`` and ``sql`` of a corpus into headers, sel, conds, relevant."""
    cut = compute_once(df, {"_list": F.regexp_extract("sql", CONDITION_COLUMNS, 1)})
    parsed = compute_once(cut, {
        "headers": extract_headers(F.col("table")),
        "sel": selected_column(F.col("sql")),
        "conds": _numbers_of(F.col("_list")),
    }).drop("_list")
    return compute_once(parsed, {
        "relevant": relevant_indices(F.col("headers"), F.col("sel"), F.col("conds"))
    })


def usable_qa_rows(parsed: DataFrame) -> DataFrame:
    """Rows with two headers or more, a selected column and something relevant."""
    return parsed.where(
        (F.size("headers") >= 2) & F.col("sel").isNotNull() & (F.size("relevant") > 0)
    )


def column_pairs(usable: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """``(key, question, header, header_pos, label)``: every relevant header as 1.0 and up to
    twice as many irrelevant ones as 0.0, chosen by hash order; where all of them are taken, none is hashed."""
    listed = compute_once(usable.select(key, "question", "headers", "relevant"), {
        "_other": F.array_except(F.sequence(F.lit(0), F.size("headers") - 1), "relevant")})
    room = 2 * F.size("relevant")
    shuffled = F.sort_array(F.transform(
        "_other", lambda i: F.struct(seeded_md5(seed, F.col(key), i).alias("h"), i.alias("pos"))
    ))
    # chosen in a step of their own, as lambdas keep a whole step from being compiled
    listed = compute_once(listed, {"_chosen": F.when(F.size("_other") <= room, F.col("_other")).otherwise(
        F.slice(shuffled, 1, room)["pos"])}).drop("_other")
    # a position is relevant if it comes before the negatives
    picks = F.posexplode_outer(F.concat("relevant", "_chosen")).alias("_at", "header_pos")
    return listed.select(key, "question", "headers", F.size("relevant").alias("_hits"), picks).select(
        key, "question", F.get("headers", F.col("header_pos")).alias("header"), "header_pos",
        F.when(F.col("_at").isNull(), None).otherwise((F.col("_at") < F.col("_hits")).cast("double")).alias("label"),
    )


# --- question/table corpus ----------------------------------------------------------------

def _draws(key: Column, free: Column, n: int, seed: int) -> Column:
    """``min(n, free)`` distinct numbers below ``free``: uniform sampling without replacement
    in one pass (Floyd's method, Communications of the ACM 30, 1987), one hash per draw."""
    def draw(free: Column) -> Column:
        first = F.greatest(free - n, F.lit(0))

        def step(taken: Column, top: Column) -> Column:
            pick = md5_number(seeded_md5(seed, key, top - first)) % (top + 1)
            return F.array_append(taken, F.when(F.array_contains(taken, pick), top).otherwise(pick))

        tops = F.filter(F.sequence(first, first + n - 1), lambda top: top < free)
        return F.aggregate(tops, F.array().cast("array<bigint>"), step)

    return let(free.cast("bigint"), draw)


def _skip_positions(draw: Column, taken: Column) -> Column:
    """The position of the draw-th vocabulary entry that is not among the sorted positions."""
    return F.aggregate(taken, draw, lambda at, p: F.when(p <= at, at + 1).otherwise(at))


def table_negatives(
    queries: DataFrame, vocabulary: DataFrame, key: str, n: int = NUM_NEGATIVES,
    seed: int = SEED, limit: int | None = None,
) -> DataFrame:
    """Add ``negatives``: up to ``n`` vocabulary tables that are not among ``tables``; none where
    ``tables`` is null. Rows with one key have the same draws, and stay rows of their own.

    Each query draws positions in the vocabulary without its own tables, so the work per
    query is n draws and not a pass over the vocabulary. A vocabulary measured to be small
    travels as one array and nothing is shuffled; beyond that, names and positions are
    exchanged by joins. Both ways give the same rows.
    """
    positions = written(dense_positions(vocabulary, "table"), "vocabulary")
    total = positions.agg(F.count(F.lit(1)).alias("n")).scalar()
    free = F.when(F.col("tables").isNull(), F.lit(0).cast("bigint")).otherwise(total - F.size("_taken"))
    if small_enough(positions, IN_ROW_BYTES if limit is None else limit):
        entries = F.sort_array(F.collect_list(F.struct("position", "table")))
        names = positions.agg(F.transform(entries, lambda e: e["table"]).alias("names")).scalar()
        placed = queries.withColumn("_names", names).withColumn("_taken", F.sort_array(F.transform(
            F.array_intersect("tables", "_names"), lambda t: F.array_position("_names", t) - 1
        ))).withColumn("_free", free)
        drawn = placed.withColumn("_draws", _draws(F.col(key), F.col("_free"), n, seed))
        picked = let(F.col("_taken"), lambda taken: F.transform("_draws", lambda d: F.get(
            "_names", _skip_positions(d, taken).cast("int")
        )))
        return drawn.withColumn("negatives", F.coalesce(picked, F.array().cast("array<string>"))).drop(
            "_names", "_taken", "_free", "_draws")
    # numbered and written once, so that a row keeps its number whatever is computed again
    rows = written(queries.withColumn("_row", F.monotonically_increasing_id()), "pair-queries")
    own = lookup_join(
        rows.select("_row", F.explode_outer(F.array_distinct("tables")).alias("table")).where(
            "table IS NOT NULL"),
        positions, "table", limit=limit,
    ).groupBy("_row").agg(F.sort_array(F.collect_list("position")).alias("_taken"))
    drawn = (
        rows.join(own, "_row", "left")
        .withColumn("_taken", F.coalesce("_taken", F.array().cast("array<bigint>")))
        .withColumn("_free", free)
        .withColumn("_draws", _draws(F.col(key), F.col("_free"), n, seed))
    )
    picks = drawn.select("_row", "_taken", F.posexplode_outer("_draws").alias("_at", "_draw")).where(
        "_draw IS NOT NULL"
    ).select(
        "_row", "_at", _skip_positions(F.col("_draw"), F.col("_taken")).alias("position")
    )
    named = picks.join(positions, "position").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("_at", "table"))).alias("_picked")
    )
    picked = F.transform("_picked", lambda p: p["table"])
    return rows.join(named, "_row", "left").withColumn(
        "negatives", F.coalesce(picked, F.array().cast("array<string>"))
    ).drop("_picked", "_row")


def first_positive(tables: Column) -> Column:
    """One positive table per query: the first in name order, null when there is none."""
    return F.array_min(tables)


def ranking_triplets(
    queries: DataFrame, vocabulary: DataFrame, key: str, n: int = NUM_NEGATIVES,
    seed: int = SEED, limit: int | None = None,
) -> DataFrame:
    """Query, one positive and the negatives in one record."""
    return table_negatives(queries, vocabulary, key, n, seed, limit).withColumn(
        "positive", first_positive(F.col("tables"))
    )
