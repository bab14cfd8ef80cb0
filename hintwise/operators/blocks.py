"""Scoring every question against every catalog entry in blocks.

A pair of rows is never a row of any DataFrame here. Both sides are packed into blocks of at
most ``PACK_ROWS`` vectors, and a task multiplies two blocks as matrices.

* A catalog of up to ``PACK_ROWS`` entries (the usual schema) is one block. It is handed to all
  question blocks as a scalar, and the ranks come straight out of the task: no shuffle, no join.
* A larger catalog forms a grid (the 1-Bucket-Theta layout of Okcan and Riedewald, SIGMOD
  2011): catalog blocks are dealt to rows of the grid and question blocks to columns. A cell holds its
  catalog blocks, about ``HELD_BLOCKS`` of them, and reads its question blocks one after the other. It keeps the k best
  entries of each question over all of its catalog blocks, so k rows per question and cell leave the task, and a window
  keeps the best k of the cells' winners. Rows and columns are sized so that the two sides are copied as little
  as possible, and blocks of equal size are dealt by hash, so no cell is hot whatever the keys
  look like.
* Sparse catalogs are packed by their heaviest terms, and a block knows the largest weight of each of its terms. These
  bound the score of any of its entries: a cell takes blocks by falling bound, and multiplies a block only with the questions
  whose k best entries so far the bound does not exclude. The result is exact.
* Where such a grid would copy too much, a task takes a group of questions instead, reads all blocks of the stored catalog
  one after the other, and keeps the k best of each question: nothing but the questions is shuffled, and no window is needed.
* A whole ranking has no k. A task takes a few questions, reads the blocks of the catalog one after the other, keeps four bytes
  per score and sorts them question by question: no pair is shuffled or written, and no task holds more than about
  ``RANKED_SCORES`` scores. Where a task could not hold the names of all entries, scores are dealt out by ranges of
  (question, score, name), ranked within a range and shifted by what a question has in the ranges before.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hintwise.operators.scaling import by_ranges, measured_bytes, small_batches, written

# the functions below run in Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK_ROWS = 1024
PACK_VALUES = 1_000_000
TERM_CHUNK = 2048
CELLS_PER_TASK = 4
# catalog blocks that a cell holds, on average
HELD_BLOCKS = 16
# entries and values that a cell of dense vectors holds: such blocks are small
HELD_ROWS = 1 << 17
HELD_VALUES = 8_000_000
# blocks that travel to a Python worker at once
BATCH_BYTES = 1 << 24
# values and results that a grid of cells may shuffle, and questions that a task holds beyond that, about
GRID_VALUES = 1 << 25
GROUP_ROWS = 1 << 15
# terms by which sparse entries are ordered before they are packed
ORDER_TERMS = 3
# scores are compared at this many digits, so that summation order cannot decide a rank
SCORE_DIGITS = 9
# scores of whole rankings that a task holds, about, and bytes of names beside them at most
RANKED_SCORES = 1 << 25
RANKED_NAMES = 1 << 27
# rows of a ranking that leave a task at once
RANKED_BATCH = 1 << 16
# stands for a score that is not a number, which goes first, as Spark sorts it
NOT_A_SCORE = 2 * 10 ** SCORE_DIGITS


def _heaviest(terms: str, weights: str) -> Column:
    """The ``ORDER_TERMS`` terms of the largest weights, the heaviest first."""
    entries = F.transform(F.arrays_zip(F.col(terms).alias("t"), F.col(weights).alias("w")), lambda e: F.struct((-e["w"]).alias("w"), e["t"].alias("t")))
    return F.transform(F.slice(F.sort_array(entries), 1, ORDER_TERMS), lambda e: e["t"])


def _pack(df: DataFrame, key: str, terms: str | None, weights: str, by_terms: bool = False, tasks: int = 1) -> DataFrame:
    """Blocks ``(ids, ptr, terms, weights, peak_terms, peaks)`` of unit vectors, streamed per partition.
    The peaks are the distinct terms of a block with their largest absolute weights.

    Rows are sorted by key inside the partition, so a recomputed task forms the same blocks; by the
    heaviest terms first, if ``by_terms`` asks for blocks of entries that are alike, which ``tasks`` then pack.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(key_type)),
        T.StructField("ptr", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("peak_terms", T.ArrayType(T.LongType())),
        T.StructField("peaks", T.ArrayType(T.DoubleType())),
    ])
    columns = [F.col(key).alias("id")]
    columns.append(F.col(terms).alias("terms") if terms else F.lit(None).cast("array<bigint>").alias("terms"))
    columns.append(F.coalesce(F.col(weights).cast("array<double>"), F.array().cast("array<double>")).alias("weights"))
    if by_terms:
        near = [F.get(_heaviest("terms", "weights"), F.lit(i)).alias(f"_o{i}") for i in range(ORDER_TERMS)]
        order = [f"_o{i}" for i in range(ORDER_TERMS)]
        ordered = df.select(*columns).select("*", *near).repartitionByRange(tasks, *order, "id").sortWithinPartitions(*order, "id").drop(*order)
    else:
        ordered = df.select(*columns).sortWithinPartitions("id")

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        weights = rows.column("weights").combine_chunks()
        lengths = np.asarray(pc.list_value_length(weights))
        values = np.asarray(weights.flatten(), dtype=np.float64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        norms = np.sqrt(np.bincount(owner, weights=values * values, minlength=len(lengths)))
        codes = np.asarray(rows.column("terms").combine_chunks().flatten()) if terms else np.zeros(0, np.int64)
        unit = values / np.maximum(norms, 1e-12)[owner]
        known, place = np.unique(codes, return_inverse=True)
        peaks = np.zeros(len(known))
        if terms:
            np.maximum.at(peaks, place, np.abs(unit))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([rows.column("id").to_pylist()], pa.list_(rows.schema.field("id").type)),
                pa.array([np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([codes], pa.list_(pa.int64())),
                pa.array([unit], pa.list_(pa.float64())),
                pa.array([known], pa.list_(pa.int64())),
                pa.array([peaks], pa.list_(pa.float64())),
            ],
            names=["block", "ids", "ptr", "terms", "weights", "peak_terms", "peaks"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, n_rows, n_values = [], 0, 0
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("weights"))))
            start = 0
            while start < batch.num_rows:
                used = ends[start - 1] if start else 0
                fitting = int(np.searchsorted(ends, used + PACK_VALUES - n_values, side="right"))
                stop = min(batch.num_rows, start + PACK_ROWS - n_rows, fitting)
                if stop <= start and not held:
                    stop = start + 1
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    n_rows += stop - start
                    n_values += int(ends[stop - 1] - used)
                    start = stop
                if start < batch.num_rows:
                    yield block(pa.Table.from_batches(held), number)
                    number += 1
                    held, n_rows, n_values = [], 0, 0
        if held:
            yield block(pa.Table.from_batches(held), number)

    return ordered.mapInArrow(pack, schema)


def _dense_matrix(ptr: np.ndarray, val: np.ndarray, width: int) -> np.ndarray:
    """Equally long vectors as rows; a missing vector is all zeros."""
    filled = np.zeros((len(ptr) - 1, width))
    filled[np.arange(width) < np.diff(ptr)[:, None]] = val
    return filled


def _dense_products(asked: _Block, entries: _Block) -> np.ndarray:
    """All dot products of two blocks of equally long vectors."""
    width = int(max(np.diff(asked.ptr).max(), np.diff(entries.ptr).max()))
    return asked.matrix(width) @ entries.matrix(width).T


def _sparse_matrix(block: _Block, chunk: np.ndarray) -> np.ndarray:
    """The weights of some terms, a column per term."""
    filled = np.zeros((len(block.ptr) - 1, len(chunk)))
    slot = np.minimum(np.searchsorted(chunk, block.terms), len(chunk) - 1)
    hit = chunk[slot] == block.terms
    filled[block.owners()[hit], slot[hit]] = block.weights[hit]
    return filled


def _sparse_products(asked: _Block, entries: _Block) -> np.ndarray:
    """All dot products of two blocks of sparse vectors, a chunk of shared terms at a time."""
    shared = np.intersect1d(asked.distinct_terms(), entries.distinct_terms(), assume_unique=True)
    if not len(shared):
        return np.zeros((len(asked.ptr) - 1, len(entries.ptr) - 1))
    scores = None
    for at in range(0, len(shared), TERM_CHUNK):
        chunk = shared[at:at + TERM_CHUNK]
        part = _sparse_matrix(asked, chunk) @ _sparse_matrix(entries, chunk).T
        scores = part if scores is None else scores + part
    return scores


def sortable(ids: pa.Array) -> pa.Array | pa.ChunkedArray:
    """Names in a form that Arrow can sort: texts as their bytes, pairs of names as a number each."""
    if pa.types.is_struct(ids.type):
        flat = pa.Table.from_arrays(ids.flatten(), names=[f"f{i}" for i in range(ids.type.num_fields)])
        order = pc.sort_indices(flat, sort_keys=[(n, "ascending") for n in flat.column_names])
        rank = np.empty(len(ids), np.int64)
        rank[np.asarray(order)] = np.arange(len(ids))
        return pa.array(rank)
    return ids


def _best(scores: np.ndarray, k: int | None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, entry, place) of the k best entries per question; ties go by ``names``, or to earlier entries."""
    if names is not None and (np.diff(names) < 0).any():
        by_name = np.argsort(names)
        question, entry, place = _best(scores[:, by_name], k)
        return question, by_name[entry], place
    n_q, n_c = scores.shape
    if k is None or k >= n_c:
        order = np.argsort(-scores, axis=1, kind="stable")
    else:
        bar = np.partition(scores, n_c - k, axis=1)[:, n_c - k, None]
        level = scores == bar
        room = k - (scores > bar).sum(axis=1, keepdims=True)
        keep = (scores > bar) | (level & (np.cumsum(level, axis=1) <= room))
        kept = np.nonzero(keep)[1].reshape(n_q, k)
        places = np.argsort(-np.take_along_axis(scores, kept, axis=1), axis=1, kind="stable")
        order = np.take_along_axis(kept, places, axis=1)
    width = order.shape[1]
    question = np.repeat(np.arange(n_q), width)
    return question, order.ravel(), np.tile(np.arange(1, width + 1), n_q)


@dataclass
class _Block:
    """A block as arrays, and what was made of them."""

    number: int
    ids: pa.Array
    ptr: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    peak_terms: np.ndarray
    peaks: np.ndarray
    made: dict = field(default_factory=dict, repr=False)

    def matrix(self, width: int) -> np.ndarray:
        """The vectors as rows, made once for blocks that are multiplied often."""
        if width not in self.made:
            self.made[width] = _dense_matrix(self.ptr, self.weights, width)
        return self.made[width]

    def owners(self) -> np.ndarray:
        """The row of each entry."""
        if "owners" not in self.made:
            self.made["owners"] = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))
        return self.made["owners"]

    def distinct_terms(self) -> np.ndarray:
        if "terms" not in self.made:
            self.made["terms"] = np.unique(self.terms)
        return self.made["terms"]

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, prefix: str) -> _Block:
        def one(name: str) -> np.ndarray:
            return np.asarray(batch.column(f"{prefix}{name}")[i].values)

        ids = next(x for n in (f"{prefix}ids", "ids_0", "ids_1") if n in batch.schema.names and (x := batch.column(n)[i]).is_valid)
        return cls(batch.column(f"{prefix}block")[i].as_py(), ids.values, one("ptr"), one("terms"),
                   one("weights"), one("peak_terms"), one("peaks"))

    def copied(self) -> _Block:
        """The block without its batch."""
        return _Block(self.number, self.ids.take(pa.array(np.arange(len(self.ids)))), *(
            x.copy() for x in (self.ptr, self.terms, self.weights, self.peak_terms, self.peaks)))

    def taken(self, rows: np.ndarray) -> _Block:
        """The block of some of the rows."""
        if len(rows) == len(self.ptr) - 1:
            return self
        lengths = np.diff(self.ptr)[rows]
        at = np.repeat(self.ptr[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return _Block(self.number, self.ids, np.concatenate([[0], np.cumsum(lengths)]), self.terms[at] if len(self.terms) else self.terms,
                      self.weights[at], self.peak_terms, self.peaks)


def block_products(asked: _Block, entries: _Block, sparse: bool) -> np.ndarray:
    """All cosines of two blocks, but for their last digits."""
    return (_sparse_products if sparse else _dense_products)(asked, entries)


def compared(products: np.ndarray) -> np.ndarray:
    """Cosines at the digits at which they are compared."""
    # adding 0.0 turns -0.0 into 0.0
    return np.round(np.clip(products, -1.0, 1.0), SCORE_DIGITS) + 0.0


def block_scores(asked: _Block, entries: _Block, sparse: bool) -> np.ndarray:
    """All cosines of two blocks, at the digits at which they are compared."""
    return compared(block_products(asked, entries, sparse))


def block_bounds(asked: _Block, held: list[_Block]) -> np.ndarray:
    """An upper bound of each question's score in each of the held blocks, from the blocks' largest weights."""
    bounds = np.zeros((len(asked.ptr) - 1, len(held)))
    owner = np.repeat(np.arange(len(asked.ptr) - 1), np.diff(asked.ptr))
    for j, block in enumerate(held):
        if len(block.peak_terms) and len(asked.terms):
            slot = np.minimum(np.searchsorted(block.peak_terms, asked.terms), len(block.peak_terms) - 1)
            peak = np.where(block.peak_terms[slot] == asked.terms, block.peaks[slot], 0.0)
            bounds[:, j] = np.bincount(owner, weights=np.abs(asked.weights) * peak, minlength=len(bounds))
    return bounds


def _merge(best: np.ndarray, entry: np.ndarray, names: np.ndarray, question: np.ndarray, scores: np.ndarray, entries: np.ndarray) -> None:
    """Put scored entries among the k best of their questions, given in any order."""
    if not len(question):
        return
    k = best.shape[1]
    rows = np.unique(question)
    whose = np.concatenate([np.repeat(rows, k), question])
    both = np.concatenate([best[rows].ravel(), scores])
    what = np.concatenate([entry[rows].ravel(), entries])
    order = np.lexsort((np.where(what >= 0, names[what], np.iinfo(np.int64).max), -both, whose))
    starts = np.searchsorted(whose[order], rows)
    kept = order[(starts[:, None] + np.arange(k)).ravel()]
    best[rows], entry[rows] = both[kept].reshape(len(rows), k), what[kept].reshape(len(rows), k)


def cell_best(
    asked: _Block, held: list[_Block], k: int, sparse: bool, names: np.ndarray, starts: np.ndarray, floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, entries, rows multiplied): the k best entries per question over all held blocks, by score, then by
    name. ``names`` are the entries' places in the order of all names, ``starts`` the first entry of each block.

    A block is multiplied with the questions for which its bound reaches their k-th best score so far. Entries that score less than
    ``floor`` are not asked for."""
    n, multiplied = len(asked.ptr) - 1, 0
    floor = np.full(n, -np.inf) if floor is None else floor
    best = np.full((n, k), -np.inf)
    entry = np.full((n, k), -1, np.int64)
    bounds = block_bounds(asked, held) if sparse else np.full((n, len(held)), np.inf)
    for j in np.argsort(-bounds.mean(axis=0), kind="stable"):
        # scores are rounded, so a bound may fall short of one by as much
        reached = np.maximum(best[:, -1], floor)
        rows = np.flatnonzero(bounds[:, j] + 10.0 ** (1 - SCORE_DIGITS) >= reached)
        if not len(rows):
            continue
        multiplied += len(rows)
        products = block_products(asked.taken(rows), held[j], sparse)
        own = names[starts[j]:starts[j] + products.shape[1]]
        if np.isneginf(reached[rows]).any():
            q, at, _ = _best(compared(products), min(k, products.shape[1]), own)
            scores = compared(products[q, at])
        else:
            # few reach the k-th best score so far, and only those are rounded, compared and merged
            q, at = np.divmod(np.flatnonzero(products >= (reached[rows] - 10.0 ** (1 - SCORE_DIGITS))[:, None]), products.shape[1])
            scores = compared(products[q, at])
            bar, last = best[rows[q], -1], names[entry[rows[q], -1]]
            better = (scores >= floor[rows[q]]) & ((scores > bar) | ((scores == bar) & (own[at] < last)))
            q, at, scores = q[better], at[better], scores[better]
        _merge(best, entry, names, rows[q], scores, starts[j] + at)
    return best, entry, multiplied


SCORED = ("q", "c", "score", "place", "block", "at")


def _scored_schema(q_type: T.DataType, c_type: T.DataType) -> T.StructType:
    kinds = (q_type, c_type, T.DoubleType(), T.IntegerType(), T.LongType(), T.IntegerType())
    return T.StructType([T.StructField(n, t) for n, t in zip(SCORED, kinds)])


def _scored_rows(asked: _Block, ids: pa.Array, q_at: np.ndarray, c_at: np.ndarray, scores: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        asked.ids.take(pa.array(q_at)), ids.take(pa.array(c_at)), pa.array(scores), pa.array(place.astype(np.int32)),
        pa.array(np.full(len(q_at), asked.number, np.int64)), pa.array(q_at.astype(np.int32)),
    ], names=list(SCORED))


def _score_single(pairs: DataFrame, q_type: T.DataType, c_type: T.DataType, k: int | None, sparse: bool) -> DataFrame:
    """Question blocks with the one block of the catalog beside them."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, entries = _Block.of(batch, i, "q_"), _Block.of(batch, i, "c_")
                scores = block_scores(asked, entries, sparse)
                q_at, c_at, place = _best(scores, k)
                yield _scored_rows(asked, entries.ids, q_at, c_at, scores[q_at, c_at], place)

    return pairs.mapInArrow(score, _scored_schema(q_type, c_type))


def whole_scores(products: np.ndarray) -> np.ndarray:
    """Cosines at the digits at which they are compared, as whole numbers of four bytes."""
    scores = np.rint(np.clip(products, -1.0, 1.0) * 10.0 ** SCORE_DIGITS)
    scores[np.isnan(scores)] = NOT_A_SCORE
    return scores.astype(np.int32)


def whole_ranking(scores: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of names, scores) of all entries by score descending, then by name, from the
    :func:`whole_scores` of one question and the places of the entries' names."""
    keys = ((NOT_A_SCORE - scores.astype(np.int64)) << 31) | names
    keys.sort()
    scores = NOT_A_SCORE - (keys >> 31)
    return keys & ((1 << 31) - 1), np.where(scores == NOT_A_SCORE, np.nan, scores / 10.0 ** SCORE_DIGITS)


def _rank_whole(pairs: DataFrame, q_type: T.DataType, c_type: T.DataType, rows: int, sparse: bool) -> DataFrame:
    """``(q, rank, c, score)`` from pairs of blocks; a partition has all ``rows`` entries for each of its question blocks."""
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, ids, entries, seen = {}, {}, [], None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("q_block")[i].as_py()
                if number not in held:
                    asked = _Block.of(batch, i, "q_")
                    held[number] = asked, np.empty((len(asked.ids), rows), np.int32)
                asked, scores = held[number]
                if entries is None or entries.number != batch.column("c_block")[i].as_py():
                    entries = _Block.of(batch, i, "c_")
                if entries.number not in starts:
                    starts[entries.number], seen = seen, seen + len(entries.ids)
                    # a copy, as the block's names would keep its whole batch
                    ids.append(entries.ids.take(pa.array(np.arange(len(entries.ids)))))
                at = starts[entries.number]
                scores[:, at:at + len(entries.ids)] = whole_scores(block_products(asked, entries, sparse))
        if not held:
            return
        names = pa.concat_arrays(ids)
        order = pc.sort_indices(sortable(names), sort_keys=[("", "ascending")], null_placement="at_start")
        place = np.empty(rows, np.int64)
        place[np.asarray(order)] = np.arange(rows)
        names = names.take(order)
        for asked, scores in held.values():
            for j in range(len(scores)):
                c_at, found = whole_ranking(scores[j], place)
                for start in range(0, rows, RANKED_BATCH):
                    some = slice(start, min(rows, start + RANKED_BATCH))
                    yield pa.RecordBatch.from_arrays([
                        asked.ids.take(pa.array(np.full(some.stop - start, j))), pa.array(np.arange(start + 1, some.stop + 1, dtype=np.int32)),
                        names.take(pa.array(c_at[some])), pa.array(found[some], from_pandas=False),
                    ], names=["q", "rank", "c", "score"])

    return pairs.mapInArrow(ranked, T.StructType([
        T.StructField("q", q_type), T.StructField("rank", T.IntegerType()), T.StructField("c", c_type), T.StructField("score", T.DoubleType())]))


def _score_cells(cells: DataFrame, q_type: T.DataType, c_type: T.DataType, k: int | None, sparse: bool) -> DataFrame:
    """Rows of cells, the catalog blocks of each before its question blocks. Without a ``k``, all scores."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], False
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column("_row")[i].as_py(), batch.column("_column")[i].as_py())
                if here != cell:
                    cell, held, ready = here, [], False
                if batch.column("_asked")[i].as_py() == 0:
                    held.append(_Block.of(batch, i, ""))
                    continue
                if not held:
                    continue
                if not ready:
                    ids, ready = pa.concat_arrays([b.ids for b in held]), True
                    sizes = [len(b.ids) for b in held]
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    names = np.empty(len(ids), np.int64)
                    names[np.asarray(pc.sort_indices(sortable(ids)))] = np.arange(len(ids))
                asked = _Block.of(batch, i, "")
                if k is None:
                    for j, block in enumerate(held):
                        scores = block_scores(asked, block, sparse)
                        q_at, c_at = (x.ravel() for x in np.indices(scores.shape))
                        yield _scored_rows(asked, ids, q_at, starts[j] + c_at, scores.ravel(), np.zeros(scores.size))
                    continue
                best, entry, _ = cell_best(asked, held, k, sparse, names, starts)
                q_at, place = np.nonzero(entry >= 0)
                yield _scored_rows(asked, ids, q_at, entry[q_at, place], best[q_at, place], place + 1)

    return cells.mapInArrow(score, _scored_schema(q_type, c_type))


def places_of(names: pa.Array) -> np.ndarray:
    """The places of names in their order, nulls first."""
    places = np.empty(len(names), np.int64)
    places[np.asarray(pc.sort_indices(sortable(names), sort_keys=[("", "ascending")], null_placement="at_start"))] = np.arange(len(names))
    return places


def merged_best(best: np.ndarray, names: pa.Array, scores: np.ndarray, found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The k best of two lists of k per question, by score, then by name; missing ones score minus infinity."""
    n, k = best.shape
    rows = np.flatnonzero(~np.isneginf(scores[:, 0]))
    if not len(rows):
        return best, names
    slots = (rows[:, None] * k + np.arange(k)).ravel()
    both = np.hstack([best[rows], scores[rows]])
    own = pa.concat_arrays([names.take(pa.array(slots)), found.take(pa.array(slots))])
    # an entry's number among ``own``, in the order of ``both``
    number = np.hstack([np.arange(len(slots)).reshape(-1, k), len(slots) + np.arange(len(slots)).reshape(-1, k)])
    order = np.lexsort((places_of(own)[number.ravel()], -both.ravel(), np.repeat(np.arange(len(rows)), 2 * k))).reshape(len(rows), 2 * k)[:, :k]
    best = best.copy()
    best[rows] = both.ravel()[order]
    taken = np.arange(n * k)
    taken[slots] = n * k + number.ravel()[order.ravel()]
    return best, pa.concat_arrays([names, own]).take(pa.array(taken))


def _best_of_all(pairs: DataFrame, q_type: T.DataType, c_type: T.DataType, k: int, sparse: bool) -> DataFrame:
    """``(q, rank, c, score)`` of the k best entries. A partition has its question blocks, beside the first block of the
    catalog, and then the other blocks of the catalog."""
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, held, last = [], {}, [], None

        def flush() -> None:
            ids, sizes = pa.concat_arrays([b.ids for b in held]), [len(b.ids) for b in held]
            starts, names = np.concatenate([[0], np.cumsum(sizes)[:-1]]), places_of(ids)
            for i, block in enumerate(asked):
                so_far = best.get(i)
                scores, entry, _ = cell_best(block, held, k, sparse, names, starts, None if so_far is None else so_far[0][:, -1])
                found = ids.take(pa.array(np.where(entry >= 0, entry, 0).ravel()))
                best[i] = (scores, found) if so_far is None else merged_best(*so_far, scores, found)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("q_block")[i].is_valid:
                    # what is kept must not keep its whole batch
                    asked.append(_Block.of(batch, i, "q_").copied())
                number = batch.column("c_block")[i].as_py()
                if number == last:
                    continue
                if held and (len(held) >= HELD_BLOCKS * HELD_BLOCKS // 2 or sum(len(b.weights) for b in held) >= HELD_VALUES):
                    flush()
                held.append(_Block.of(batch, i, "c_").copied())
                last = number
        if held:
            flush()
        for i, block in enumerate(asked):
            scores, found = best[i]
            q_at, place = np.nonzero(~np.isneginf(scores))
            yield pa.RecordBatch.from_arrays([
                block.ids.take(pa.array(q_at)), pa.array((place + 1).astype(np.int32)), found.take(pa.array(q_at * k + place)),
                pa.array(scores[q_at, place])], names=["q", "rank", "c", "score"])

    return pairs.mapInArrow(ranked, T.StructType([
        T.StructField("q", q_type), T.StructField("rank", T.IntegerType()), T.StructField("c", c_type), T.StructField("score", T.DoubleType())]))


def _beside_all(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """The partitions of ``asked`` beside all of ``entries``, which are read as they are stored: every row of ``asked`` once, with the
    first of the entries, and every entry."""
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    one, many = entries.coalesce(1).withColumn("_c", nth), asked.withColumn("_q", nth)
    met = one.hint("shuffle_replicate_nl").crossJoin(many).where("_c = 0 OR _q = 0")
    return met.select(*entries.columns, *[F.when(F.col("_c") == 0, F.col(c)).alias(c) for c in asked.columns])


def _side(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*[
        F.col(c).alias(c if c.startswith("_") else f"{prefix}_{c}") for c in blocks.columns
    ])


def grid_shape(q_blocks: int, c_blocks: int, cells: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``cells`` cells that copies the fewest blocks: a
    question block is copied to every row, a catalog block to every column."""
    q_blocks, c_blocks = max(1, q_blocks), max(1, c_blocks)
    rows = max(1, min(round(math.sqrt(cells * c_blocks / q_blocks)), cells, c_blocks))
    columns = max(1, min(math.ceil(cells / rows), q_blocks))
    return rows, columns


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


@dataclass(frozen=True)
class PackedCatalog:
    """A catalog as blocks in the shared folder, with its measured size: packed once, ranked often."""

    blocks: DataFrame
    name: str
    name_type: T.DataType
    rows: int
    values: int
    single: bool
    sparse: bool


def pack_catalog(catalog: DataFrame, name: str, weights: str, terms: str | None = None) -> PackedCatalog:
    """Pack ``catalog`` for :func:`ranked_by_blocks`. A catalog measured to fit one block is one, so
    that one task may hold it and every executor a copy."""
    stored = written(catalog.select(name, *([terms] if terms else []), weights), "catalog-vectors")
    size = stored.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(weights)), F.lit(0)).alias("values")
    ).first()
    single = size.rows <= PACK_ROWS and size["values"] <= PACK_VALUES
    # bounds can only exclude blocks where a cell does not hold the whole catalog anyway
    many = max(size.rows / PACK_ROWS, size["values"] / PACK_VALUES) > HELD_BLOCKS
    # a task sorts and packs about as much whatever the catalog's size
    tasks = max(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["values"] / PACK_VALUES / HELD_BLOCKS))
    packed = _pack(stored.repartition(1) if single else stored, name, terms, weights, by_terms=terms is not None and many, tasks=tasks)
    blocks = written(_side(packed, "c"), "catalog-blocks")
    return PackedCatalog(
        blocks, name, catalog.schema[name].dataType, size.rows, size["values"], single, terms is not None)


def ranked_by_blocks(
    questions: DataFrame, catalog: DataFrame | PackedCatalog, query_id: str, name: str, weights: str,
    terms: str | None = None, k: int | None = None, asked_rows: int | None = None,
) -> DataFrame:
    """``(query_id, rank, name, score)`` of the k best entries per question (all for None), by
    cosine descending and then by name. ``asked_rows`` saves counting the questions."""
    packed = catalog if isinstance(catalog, PackedCatalog) else pack_catalog(catalog, name, weights, terms)
    q_type, c_type = questions.schema[query_id].dataType, packed.name_type
    spark = questions.sparkSession
    small_batches(spark, BATCH_BYTES)
    entries = packed.blocks
    asked = _side(_pack(questions, query_id, terms, weights), "q")
    if packed.single:
        block = entries.select(F.struct(*entries.columns).alias("_c")).scalar()
        pairs = asked.withColumn("_c", block).where("_c IS NOT NULL").select(*asked.columns, "_c.*")
        best = _score_single(pairs, q_type, c_type, k, terms is not None)
        return best.select(
            F.col("q").alias(query_id), F.col("place").alias("rank"), F.col("c").alias(name), "score"
        )
    blocks = math.ceil(max(packed.rows / PACK_ROWS, packed.values / PACK_VALUES))
    # several cells per task, so that dealing cells to tasks by hash evens out
    cells = CELLS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked_rows = questions.count() if asked_rows is None else asked_rows
    if k is None and measured_bytes(entries.select("c_ids")) <= RANKED_NAMES:
        # a partition of questions beside all blocks of the catalog, which are read as they are stored: nothing is shuffled but questions
        most = max(1, RANKED_SCORES // packed.rows)
        groups = max(1, math.ceil(asked_rows / most), min(asked_rows, spark.sparkContext.defaultParallelism))
        few = _side(_pack(questions.repartition(groups), query_id, terms, weights), "q")
        pairs = entries.coalesce(1).hint("shuffle_replicate_nl").crossJoin(few)
        best = _rank_whole(pairs, q_type, c_type, packed.rows, terms is not None)
        return best.select(F.col("q").alias(query_id), "rank", F.col("c").alias(name), "score")
    rows, columns = grid_shape(math.ceil(asked_rows / PACK_ROWS), blocks, cells)
    # the fewer rows, the fewer copies of the questions and results of cells
    least = blocks / HELD_BLOCKS if packed.sparse else min(blocks / HELD_BLOCKS, max(packed.rows / HELD_ROWS, packed.values / HELD_VALUES))
    rows = max(rows, math.ceil(least))
    if k is not None and asked_rows > 1 and rows * asked_rows * (k + packed.values / max(1, packed.rows)) + columns * packed.values > GRID_VALUES:
        groups = max(math.ceil(asked_rows / GROUP_ROWS), min(asked_rows, spark.sparkContext.defaultParallelism))
        few = _side(_pack(questions.repartition(groups), query_id, terms, weights), "q")
        best = _best_of_all(_beside_all(entries, few), q_type, c_type, k, packed.sparse)
        return best.select(F.col("q").alias(query_id), "rank", F.col("c").alias(name), "score")
    plain = [c.removeprefix("c_") for c in entries.columns]
    dealt = entries.toDF(*plain).select(
        "*", F.pmod(F.xxhash64("block"), F.lit(rows)).alias("_row"), F.explode(_numbers(columns)).alias("_column"), F.lit(0).alias("_asked"))
    questions_dealt = asked.toDF(*plain).select(
        "*", F.explode(_numbers(rows)).alias("_row"), F.pmod(F.xxhash64("block"), F.lit(columns)).alias("_column"), F.lit(1).alias("_asked"))
    # ids differ in type, so each side has a column of its own
    both = _with_ids(dealt, c_type, q_type, 0).unionByName(_with_ids(questions_dealt, c_type, q_type, 1))
    # a task has about as many cells whatever the catalog's size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * columns / CELLS_PER_TASK))
    grid = both.repartition(tasks, "_row", "_column").sortWithinPartitions("_row", "_column", "_asked", "block")
    best = _score_cells(grid, q_type, c_type, k, terms is not None)
    if k is None:
        return _ranked_by_ranges(best).select(F.col("q").alias(query_id), "rank", F.col("c").alias(name), "score")
    # a question is a row of a block, as two rows may have the same id
    order = W.partitionBy("block", "at").orderBy(F.desc("score"), "c")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), "rank", F.col("c").alias(name), "score")


def _with_ids(side: DataFrame, c_type: T.DataType, q_type: T.DataType, asked: int) -> DataFrame:
    kinds = (c_type, q_type)
    own = [F.col("ids").alias(f"ids_{i}") if i == asked else F.lit(None).cast(T.ArrayType(t)).alias(f"ids_{i}") for i, t in enumerate(kinds)]
    return side.select(*[c for c in side.columns if c != "ids"], *own)


def _ranked_by_ranges(scores: DataFrame) -> DataFrame:
    """Whole rankings: add ``rank`` per question (block, at). No task, window or row holds a ranking that is
    larger than a range."""
    dealt = by_ranges(scores, "block", "at", F.desc("score"), "c")
    inside = W.partitionBy("_b", "block", "at").orderBy(F.desc("score"), "c")
    counts = dealt.groupBy("block", "at", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("block", "at").orderBy("_b")
    # only a question that a range continues is shifted: at most one per range
    before = counts.select("block", "at", "_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_before")).where("_before > 0")
    return dealt.withColumn("_place", F.row_number().over(inside)).join(
        F.broadcast(before), ["block", "at", "_b"], "left").withColumn(
        "rank", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int"))
