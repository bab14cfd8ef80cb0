"""Linear models: text to labels by logistic regression, and the relevance of question/name pairs.

:func:`fit_text_labels_lr` fits all classes and tags of all heads at once. Every step of the optimizer is
one job over the stored rows: a task sums the gradient of its rows into one matrix, matrices are added
chunk by chunk, and the driver gets one matrix, whatever the number of rows, tasks or tags. Beyond
``DRIVER_WEIGHT_BYTES`` no process holds the matrix: words are dealt to chunks and rows to parts, a part gets the weights of its own
words, and the optimizer's vectors stay with their chunks; the driver sees their dot products only. There the weights of the
most frequent words, a small matrix, are fitted first by Newton's method; their second derivatives then scale the steps of the
whole fit, since those of rarer words hardly differ from the regularization.
"""

from __future__ import annotations

import math
import warnings
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit
from hintwise.operators.ranking import term_counts, text_parts
from hintwise.operators.scaling import compute_once, deleted, dense_positions, lookup_join, shared_folder, small_enough, written
from hintwise.operators.textmodel import PAIR_FEATURES, Head

REGULARIZATION = 0.01
# largest gradient component at the end
TOLERANCE = 1e-11
# pairs of steps and gradient changes that the optimizer remembers
MEMORY = 12
# cells of the gradient that are added by one task
CHUNK_CELLS = 1 << 16
# entries of rows that are multiplied at once
BLOCK_ENTRIES = 1 << 16
# cells of a block of rows as a dense matrix of their most frequent words
BLOCK_CELLS = 1 << 20
# largest matrix of weights that driver and tasks hold; the driver keeps about thirty of its size
DRIVER_WEIGHT_BYTES = 1 << 22
# largest matrix of weights at all: beyond the one above, it is dealt to tasks
MOST_WEIGHT_BYTES = 1 << 36
# of dealt weights: cells of a chunk, entries times classes of a part of the rows, remembered steps
DEALT_CELLS = 1 << 13
PART_CELLS = 1 << 24
DEALT_MEMORY = 5
# second derivatives by the weights of the most frequent words, on the driver and in every task
OFTEN_CELLS = 1 << 20
# largest gradient component by those weights before all are fitted
OFTEN_TOLERANCE = 1e-2
OFTEN_STEPS = 20


@dataclass(frozen=True)
class LinearTextModel:
    """``words(token, idf, weights)``: weights are in the order of the heads and of their classes; ``bias``
    has one weight per class. ``steps`` counts the optimizer's steps, ``small`` tells whether the words were
    measured to fit every executor."""

    words: DataFrame
    bias: tuple[float, ...]
    heads: tuple[Head, ...]
    steps: int
    small: bool


def minimize(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, max_steps: int,
) -> tuple[np.ndarray, int, bool]:
    """Minimum of a smooth convex function by limited-memory BFGS: (where, steps, whether the gradient
    fell below ``tolerance``). A step is halved until the function falls, but for its rounding error."""
    at = start
    value, slope = evaluate(at)
    pairs: deque = deque(maxlen=MEMORY)
    for step in range(max_steps):
        if np.abs(slope).max() <= tolerance:
            return at, step, True
        way, factors = slope.copy(), []
        for s, y, r in reversed(pairs):
            factors.append(r * (s * way).sum())
            way -= factors[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            way /= r * (y * y).sum()
        for (s, y, r), a in zip(pairs, reversed(factors)):
            way += (a - r * (y * way).sum()) * s
        fall, length = (way * slope).sum(), 1.0
        while True:
            there = at - length * way
            new_value, new_slope = evaluate(there)
            if new_value <= value - 1e-4 * length * fall + 1e-13 * abs(value) or length < 1e-9:
                break
            length /= 2
        s, y = there - at, new_slope - slope
        if (s * y).sum() > 0:
            pairs.append((s, y, 1 / (s * y).sum()))
        at, value, slope = there, new_value, new_slope
    return at, max_steps, False


def _loss(margins: np.ndarray, truth: np.ndarray, heads: tuple[Head, ...]) -> tuple[float, np.ndarray]:
    """Summed loss of all heads, and its derivative by the margins."""
    loss, out, at = 0.0, np.empty_like(margins), 0
    for head in heads:
        m, y = margins[:, at:at + head.size], truth[:, at:at + head.size]
        if head.multi:
            loss += (np.logaddexp(0, m) - y * m).sum()
            out[:, at:at + head.size] = 0.5 * (1 + np.tanh(m / 2)) - y
        else:
            top = m.max(axis=1, keepdims=True)
            e = np.exp(m - top)
            total = e.sum(axis=1, keepdims=True)
            loss += (np.log(total) + top).sum() - (y * m).sum()
            out[:, at:at + head.size] = e / total - y
        at += head.size
    return float(loss), out


def batch_gradient(batch: pa.RecordBatch, weights: np.ndarray, heads: tuple[Head, ...], gradient: np.ndarray) -> float:
    """Add the gradient of the rows (terms, values, classes) to ``gradient`` and return their loss. The
    last row of ``weights`` is the bias."""
    loss, width = 0.0, weights.shape[1]
    columns = [batch.column(n) for n in ("terms", "values", "classes")]
    ends = [np.asarray(c.offsets) for c in columns]
    flat = [np.asarray(c.values) for c in columns]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends[0], ends[0][first] + BLOCK_ENTRIES, "right")) - 1)
        a, b = ends[0][first], ends[0][last]
        terms, values = flat[0][a:b], flat[1][a:b]
        row = np.repeat(np.arange(last - first), np.diff(ends[0][first:last + 1]))
        margins = np.zeros((last - first, width))
        if len(terms):
            filled = np.flatnonzero(np.diff(ends[0][first:last + 1]))
            margins[filled] = np.add.reduceat(values[:, None] * weights[terms], ends[0][first:last][filled] - a)
        margins += weights[-1]
        truth = np.zeros_like(margins)
        c, d = ends[2][first], ends[2][last]
        truth[np.repeat(np.arange(last - first), np.diff(ends[2][first:last + 1])), flat[2][c:d]] = 1
        part, slope = _loss(margins, truth, heads)
        loss += part
        gradient[-1] += slope.sum(axis=0)
        if len(terms):
            order = np.argsort(terms, kind="stable")
            known = terms[order]
            starts = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
            gradient[known[starts]] += np.add.reduceat(values[order, None] * slope[row[order]], starts)
        first = last
    return loss


def second_derivatives(slope: np.ndarray, truth: np.ndarray, heads: tuple[Head, ...]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(columns of margins, second derivatives of the loss by any two of them per row), from the first derivatives: the classes of
    a single-label head together, tags one by one."""
    at, share = 0, slope + truth
    for head in heads:
        if head.multi:
            for i in range(at, at + head.size):
                yield [i], (share[:, i] * (1 - share[:, i]))[:, None, None]
        else:
            p = share[:, at:at + head.size]
            yield list(range(at, at + head.size)), p[:, :, None] * (np.eye(head.size) - p[:, None, :])
        at += head.size


def often_cells(batch: pa.RecordBatch, often: np.ndarray, weights: np.ndarray, heads: tuple[Head, ...], cells: np.ndarray) -> None:
    """Add the loss of the rows, as far as the words ``often`` and the bias tell, its gradient and its second derivatives to ``cells``."""
    width, k = weights.shape[1], len(weights)
    columns = [batch.column(n) for n in ("terms", "values", "classes")]
    ends = [np.asarray(c.offsets) for c in columns]
    flat = [np.asarray(c.values) for c in columns]
    for first in range(0, batch.num_rows, step := max(1, BLOCK_CELLS // (k + width))):
        last = min(batch.num_rows, first + step)
        a, b = ends[0][first], ends[0][last]
        row = np.repeat(np.arange(last - first), np.diff(ends[0][first:last + 1]))
        place = np.searchsorted(often, flat[0][a:b])
        known = np.flatnonzero(np.append(often, -1)[place] == flat[0][a:b])
        dense = np.zeros((last - first, k))
        dense[row[known], place[known]] = flat[1][a:b][known]
        dense[:, -1] = 1
        truth = np.zeros((last - first, width))
        c, d = ends[2][first], ends[2][last]
        truth[np.repeat(np.arange(last - first), np.diff(ends[2][first:last + 1])), flat[2][c:d]] = 1
        loss, slope = _loss(dense @ weights, truth, heads)
        cells[0] += loss
        cells[1:1 + weights.size] += (dense.T @ slope).ravel()
        at, half = 1 + weights.size, dense.astype(np.float32)
        for _, second in second_derivatives(slope, truth, heads):
            for i in range(second.shape[1]):
                for j in range(second.shape[1]):
                    by = second[:, i, j].astype(np.float32)[:, None]
                    # the product of a matrix and itself takes half the work
                    part = half * np.sqrt(np.maximum(by, 0)) if i == j else half * by
                    cells[at:at + k * k] += (part.T @ (part if i == j else half)).ravel()
                    at += k * k


def blocks_of(cells: np.ndarray, k: int, heads: tuple[Head, ...]) -> list[tuple[list[int], np.ndarray]]:
    """(columns, matrix) per independent block of the second derivatives of :func:`often_cells`; a block's weights are class by class."""
    blocks, at, width = [], 0, 0
    for head in heads:
        for columns in ([[i] for i in range(head.size)] if head.multi else [list(range(head.size))]):
            c = len(columns)
            square = cells[at:at + (c * k) ** 2].reshape(c, c, k, k).transpose(0, 2, 1, 3).reshape(c * k, c * k)
            blocks.append(([width + i for i in columns], (square + square.T) / 2))
            at += (c * k) ** 2
        width += head.size
    return blocks


def by_blocks(blocks: list[tuple[list[int], np.ndarray]], matrix: np.ndarray, change: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``change(block, weights)`` of the weights of each block, as a matrix like ``matrix``."""
    out = np.empty_like(matrix)
    for columns, block in blocks:
        out[:, columns] = change(block, matrix[:, columns].T.ravel()).reshape(len(columns), -1).T
    return out


def summed_cells(rows: DataFrame, cells_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """The sum of the tasks' ``cells_of`` their rows by one job: tasks cut their cells into chunks, which are added
    in the tasks that they are dealt to, so the driver receives one array; None if there is no row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cells_of(batches)
        for chunk in range(0, len(cells), CHUNK_CELLS):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk // CHUNK_CELLS], pa.int32()),
                "cells": pa.array([cells[chunk:chunk + CHUNK_CELLS].tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, None
        for batch in batches:
            for c, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist()):
                if c != chunk:
                    if chunk is not None:
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})
                    chunk, total = c, np.zeros(len(cells) // 8)
                total += np.frombuffer(cells)
        if chunk is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, cells binary"
    parts = rows.mapInArrow(partial, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, schema).collect()
    return np.concatenate([np.frombuffer(p.cells) for p in sorted(parts)]) if parts else None


def summed_gradient(rows: DataFrame, weights: np.ndarray, heads: tuple[Head, ...]) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows by one job; the driver receives one matrix."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        gradient, loss = np.zeros(held.value.shape), 0.0
        for batch in batches:
            loss += batch_gradient(batch, held.value, heads, gradient)
        return np.append(gradient.ravel(), loss)

    cells = summed_cells(rows, cells_of)
    held.destroy()
    if cells is None:
        return 0.0, np.zeros(weights.shape)
    return float(cells[-1]), cells[:-1].reshape(weights.shape)


def descent(products: np.ndarray, first: float = 1.0) -> np.ndarray:
    """The direction of limited-memory BFGS as factors of its vectors: the gradient, the steps from the oldest on, the
    gradient changes alike. ``products`` are the dot products of any two of them, ``first`` is the length without a step."""
    size = (len(products) - 1) // 2
    way = np.zeros(len(products))
    way[0] = 1.0
    pairs = [(1 + i, 1 + size + i) for i in range(size) if products[1 + i, 1 + size + i] > 0]
    factors = []
    for s, y in reversed(pairs):
        factors.append(products[s] @ way / products[s, y])
        way[y] -= factors[-1]
    if pairs:
        s, y = pairs[-1]
        way *= products[s, y] / products[y, y]
    else:
        way *= first
    for (s, y), a in zip(pairs, reversed(factors)):
        way[s] += a - products[y] @ way / products[s, y]
    return way


def _vectors_of(state: pa.RecordBatch | pa.Table, i: int) -> np.ndarray:
    """The gradient, steps and gradient changes of a chunk, one below the other."""
    held = [state.column(n)[i] for n in ("slope", "moves", "changes")]
    return np.stack([np.frombuffer(b) for b in [held[0].as_py(), *held[1].as_py(), *held[2].as_py()]])


def _moved(state: pa.RecordBatch | pa.Table, i: int, way: np.ndarray) -> np.ndarray:
    """The weights of a chunk, moved by ``way``, factors of its vectors."""
    at = np.frombuffer(state.column("at")[i].as_py())
    return at - way @ _vectors_of(state, i) if way.any() else at


def _parts_of(cells: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, terms, cells) by chunk."""
    return sorted(((c, np.frombuffer(t, np.int32), np.frombuffer(x)) for c, t, x in zip(
        *(cells.column(n).to_pylist() for n in ("chunk", "terms", "cells")))), key=lambda p: p[0])


class DealtFit:
    """The fit of weights that are too many for one process. ``state`` is a stored table with one row per chunk of words: its
    weights, gradient, last steps and gradient changes, and its shares of the loss and of the dot products. Rows are dealt to parts, by
    their rarest word where that is not frequent, so that few parts share a rare word; a part and a chunk exchange the cells
    of the words that both have (``routes``). An evaluation is one job, and writes the next state.

    The weights of the words ``often`` and the bias are with the driver, which sends them to all parts. The optimizer sees them in
    coordinates in which their second derivatives are those of the regularization alone, as those of rare words almost are, so
    that few steps are needed. Their summed gradient is the row ``OFTEN`` of the state."""

    STATE = "chunk int, at binary, slope binary, moves array<binary>, changes array<binary>, products array<double>, loss double, square double, peak double"
    CELLS = "part int, chunk int, terms binary, cells binary, loss double"
    OFTEN = -1

    def __init__(self, rows: DataFrame, vocabulary: DataFrame, heads: tuple[Head, ...], size: int, n: int, regularization: float):
        self.spark: SparkSession = rows.sparkSession
        self.vocabulary, self.heads, self.size, self.regularization = vocabulary, heads, size, regularization
        self.n = max(n, 1)
        self.width = sum(h.size for h in heads)
        self.per_chunk = max(1, DEALT_CELLS // self.width)
        most = math.isqrt(OFTEN_CELLS // sum(h.size if h.multi else h.size ** 2 for h in heads)) - 1
        self.often = np.sort(np.array([r.term for r in vocabulary.orderBy("idf", "term").limit(max(0, most)).select("term").collect()], np.int32))
        entries = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(entries * self.width / PART_CELLS))
        # a word in more than one of ``parts`` texts would fill a part of its own
        rare = F.exp(1 - F.col("rare.idf")) * parts < 1
        part = F.pmod(F.when(rare, F.xxhash64("rare.term")).otherwise(F.col("hash")), F.lit(parts)).cast("int")
        self.rows = rows.select(self._apart(part, parts).alias("part"), "terms", "values", "classes").repartition(
            parts, "part").sortWithinPartitions("part").persist(StorageLevel.DISK_ONLY)
        self.routes = written(self.rows.groupBy("part").applyInArrow(self._routed(), "part int, chunk int, terms binary"), "lr-routes")
        self.folder = None
        # weights of ``often`` and the bias, and their optimizer's vectors
        self.held = np.zeros((len(self.often) + 1, self.width))
        self.blocks, self.vectors = self._often_first(), np.zeros((1, self.held.size))
        self.place = by_blocks(self.blocks, self.held, lambda lower, w: lower.T @ w / math.sqrt(self.scale))
        self.state = self._start()

    @property
    def scale(self) -> float:
        return self.regularization or 1.0

    def _apart(self, part: Column, parts: int) -> Column:
        """Numbers for the parts that are dealt to a partition each."""
        numbers = self.spark.range(64 * parts).select(F.col("id").cast("int").alias("number")).groupBy(
            F.pmod(F.hash("number"), F.lit(parts)).alias("partition")).agg(F.min("number").alias("number")).collect()
        free = {r.partition: r.number for r in numbers}
        return F.get(array_lit([free.get(i, 64 * parts + i) for i in range(parts)]), part)

    def _routed(self):
        often, per_chunk = self.often, self.per_chunk

        def routed(rows: pa.Table) -> pa.Table:
            terms = np.setdiff1d(np.asarray(rows.column("terms").combine_chunks().flatten()), often).astype(np.int32)
            chunks, starts = np.unique(terms // per_chunk, return_index=True)
            return pa.table({
                "part": pa.array(np.full(len(chunks), rows.column("part")[0].as_py(), np.int32)), "chunk": pa.array(chunks.astype(np.int32)),
                "terms": pa.array([t.tobytes() for t in np.split(terms, starts[1:])] if len(chunks) else [], pa.binary())})

        return routed

    def _often_first(self) -> list[tuple[list[int], np.ndarray]]:
        """Fit the weights of ``often`` and the bias as if there were no other words, by Newton's method, one job per step. The
        result are the lower triangles of the second derivatives there, regularization included, one per independent block."""
        often, heads, k, shape = self.often, self.heads, len(self.often) + 1, self.held.shape

        def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray, list[tuple[list[int], np.ndarray]]]:
            def cells_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                cells = np.zeros(1 + weights.size + k * k * sum(h.size if h.multi else h.size ** 2 for h in heads))
                for batch in batches:
                    often_cells(batch, often, weights, heads, cells)
                return cells

            cells = summed_cells(self.rows.select("terms", "values", "classes"), cells_of)
            if cells is None:
                cells = cells_of(iter(()))
            cells = cells / self.n
            value = cells[0] + self.regularization / 2 * (weights * weights).sum()
            lower = [(c, np.linalg.cholesky(b + self.scale * np.eye(len(b)))) for c, b in blocks_of(cells[1 + weights.size:], k, heads)]
            return value, cells[1:1 + weights.size].reshape(shape) + self.regularization * weights, lower

        value, slope, lower = evaluate(self.held)
        for _ in range(OFTEN_STEPS):
            if np.abs(slope).max() <= OFTEN_TOLERANCE:
                break
            way, length = by_blocks(lower, slope, lambda low, g: np.linalg.solve(low.T, np.linalg.solve(low, g))), 1.0
            while True:
                there = self.held - length * way
                new = evaluate(there)
                if new[0] <= value or length < 1e-6:
                    break
                length /= 2
            self.held, (value, slope, lower) = there, new
        return lower

    def _start(self) -> DataFrame:
        size, per_chunk, width = self.size, self.per_chunk, self.width

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in batch.column("id").to_pylist():
                    zero = np.zeros(0 if chunk < 0 else (min(size, (chunk + 1) * per_chunk) - chunk * per_chunk) * width).tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk], pa.int32()), *[pa.array([zero], pa.binary())] * 2, *[pa.array([[]], pa.list_(pa.binary()))] * 2,
                        pa.array([[]], pa.list_(pa.float64())), *[pa.array([0.0])] * 3],
                        names=["chunk", "at", "slope", "moves", "changes", "products", "loss", "square", "peak"])

        return self.spark.range(self.OFTEN, max(1, math.ceil(size / per_chunk))).mapInArrow(start, self.STATE)

    def _stepped(self, way: np.ndarray, remember: bool, held: np.ndarray) -> DataFrame:
        """The state after a move by ``way``, factors of the vectors, where the words ``often`` and the bias have the weights ``held``."""
        heads, often, per_chunk, width, n, regularization = self.heads, self.often, self.per_chunk, self.width, self.n, self.regularization
        sums = self.OFTEN

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("chunk").slice(i, 1), pa.array([_moved(batch, i, way).tobytes()], pa.binary())], names=["chunk", "cells"])

        def asked(weights: pa.Table, routes: pa.Table) -> pa.Table:
            chunk = weights.column("chunk")[0].as_py()
            own = np.frombuffer(weights.column("cells")[0].as_py()).reshape(-1, width)
            cells = [own[np.frombuffer(t, np.int32) - chunk * per_chunk].tobytes() for t in routes.column("terms").to_pylist()]
            return pa.table([routes.column("part"), routes.column("chunk"), routes.column("terms"), pa.array(cells, pa.binary()),
                             pa.array(np.zeros(len(cells)))], names=["part", "chunk", "terms", "cells", "loss"])

        def gradients(rows: pa.Table, cells: pa.Table) -> pa.Table:
            own = _parts_of(cells)
            rare = np.concatenate([np.zeros(0, np.int32), *(t for _, t, _ in own)])
            terms = np.sort(np.concatenate([rare, often]))
            here, there = np.searchsorted(terms, rare), np.append(np.searchsorted(terms, often), len(terms))
            # the bias is the word after the last, and every row's
            weights = np.empty((len(terms) + 1, width))
            weights[here] = np.concatenate([np.zeros(0), *(x for _, _, x in own)]).reshape(-1, width)
            weights[there] = held
            gradient, loss = np.zeros(weights.shape), 0.0
            for batch in rows.to_batches():
                listed = batch.column("terms")
                batch = batch.set_column(batch.schema.get_field_index("terms"), "terms", pa.ListArray.from_arrays(
                    listed.offsets, pa.array(np.searchsorted(terms, np.asarray(listed.values)))))
                loss += batch_gradient(batch, weights, heads, gradient)
            ends = np.cumsum([len(t) for _, t, _ in own])[:-1]
            part = rows.column("part")[0].as_py()
            return pa.table({
                "part": pa.array(np.full(len(own) + 1, part, np.int32)), "chunk": pa.array([sums] + [c for c, _, _ in own], pa.int32()),
                "terms": pa.array([b""] + [t.tobytes() for _, t, _ in own], pa.binary()),
                "cells": pa.array([gradient[there].tobytes()] + ([x.tobytes() for x in np.split(gradient[here], ends)] if own else []), pa.binary()),
                "loss": pa.array([loss] + [0.0] * len(own))})

        def stepped(state: pa.Table, cells: pa.Table) -> pa.Table:
            chunk, loss = state.column("chunk")[0].as_py(), math.fsum(cells.column("loss").to_pylist())
            if chunk == sums:
                total = np.zeros(held.size)
                for part in cells.sort_by("part").column("cells").to_pylist():
                    total += np.frombuffer(part)
                return pa.table([
                    pa.array([chunk], pa.int32()), pa.array([b""], pa.binary()), pa.array([total.tobytes()], pa.binary()),
                    *[pa.array([[]], pa.list_(pa.binary()))] * 2, pa.array([[]], pa.list_(pa.float64())), pa.array([loss]),
                    *[pa.array([0.0])] * 2], names=["chunk", "at", "slope", "moves", "changes", "products", "loss", "square", "peak"])
            vectors, at, there = _vectors_of(state, 0), _moved(state, 0, way * 0), _moved(state, 0, way)
            total = np.zeros((len(at) // width, width))
            for _, terms, part in _parts_of(cells):
                total[terms - chunk * per_chunk] += part.reshape(-1, width)
            slope = total.ravel() / n + regularization * there
            past = (len(vectors) - 1) // 2
            moves, changes = list(vectors[1:1 + past]), list(vectors[1 + past:])
            if remember:
                moves, changes = [*moves, there - at][-DEALT_MEMORY:], [*changes, slope - vectors[0]][-DEALT_MEMORY:]
            kept = np.stack([slope, *moves, *changes])
            return pa.table([
                pa.array([chunk], pa.int32()), pa.array([there.tobytes()], pa.binary()), pa.array([slope.tobytes()], pa.binary()),
                *[pa.array([[v.tobytes() for v in vs]], pa.list_(pa.binary())) for vs in (moves, changes)],
                pa.array([(kept @ kept.T).ravel()], pa.list_(pa.float64())), pa.array([loss]),
                pa.array([float(there @ there)]), pa.array([float(np.abs(slope).max(initial=0.0))])],
                names=["chunk", "at", "slope", "moves", "changes", "products", "loss", "square", "peak"])

        weights = self.state.where(F.col("chunk") != sums).select("chunk", "at", "slope", "moves", "changes").mapInArrow(
            moved, "chunk int, cells binary")
        local = weights.groupBy("chunk").cogroup(self.routes.groupBy("chunk")).applyInArrow(asked, self.CELLS)
        back = self.rows.groupBy("part").cogroup(local.groupBy("part")).applyInArrow(gradients, self.CELLS)
        return self.state.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(stepped, self.STATE)

    def _evaluated(self, way: np.ndarray, remember: bool = True) -> tuple[tuple, float, float, np.ndarray]:
        """What :meth:`_take` takes after a move, the value there, the largest component of the gradient, and the dot products."""
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            products, loss, square, peak, often = None, 0.0, 0.0, 0.0, None
            for batch in batches:
                for i in range(batch.num_rows):
                    if batch.column("chunk")[i].as_py() < 0:
                        often = batch.column("slope")[i].as_py()
                    else:
                        own = np.asarray(batch.column("products")[i].values)
                        products = own if products is None else products + own
                loss, square = loss + math.fsum(batch.column("loss").to_pylist()), square + math.fsum(batch.column("square").to_pylist())
                peak = max([peak, *batch.column("peak").to_pylist()])
            yield pa.RecordBatch.from_arrays([
                pa.array([products], pa.list_(pa.float64())), *[pa.array([x]) for x in (loss, square, peak)], pa.array([often], pa.binary())],
                names=["products", "loss", "square", "peak", "often"])

        place = self.place - (way @ self.vectors).reshape(self.place.shape)
        held = by_blocks(self.blocks, place, lambda lower, z: math.sqrt(self.scale) * np.linalg.solve(lower.T, z))
        folder = shared_folder(self.spark, "lr-state")
        self._stepped(way, remember, held).write.parquet(folder)
        state = self.spark.read.schema(self.STATE).parquet(folder)
        own = F.when(F.col("chunk") == self.OFTEN, F.col("slope")).alias("slope")
        parts = state.select("chunk", own, "products", "loss", "square", "peak").mapInArrow(
            summed, "products array<double>, loss double, square double, peak double, often binary").collect()
        total = next(np.frombuffer(p.often) for p in parts if p.often is not None).reshape(held.shape)
        slope = total / self.n + self.regularization * held
        there = by_blocks(self.blocks, slope, lambda lower, g: math.sqrt(self.scale) * np.linalg.solve(lower, g)).ravel()
        past = (len(self.vectors) - 1) // 2
        moves, changes = list(self.vectors[1:1 + past]), list(self.vectors[1 + past:])
        if remember:
            moves = [*moves, (place - self.place).ravel()][-DEALT_MEMORY:]
            changes = [*changes, there - self.vectors[0]][-DEALT_MEMORY:]
        vectors = np.stack([there, *moves, *changes])
        products = np.sum([p.products for p in parts if p.products], axis=0).reshape(len(vectors), -1) + vectors @ vectors.T
        square = math.fsum(p.square for p in parts) + float((held * held).sum())
        value = math.fsum(p.loss for p in parts) / self.n + self.regularization / 2 * square
        peak = max(float(np.abs(slope).max()), *(p.peak for p in parts))
        return (state, folder, place, held, vectors), value, peak, products

    def _take(self, state: DataFrame, folder: str, place: np.ndarray, held: np.ndarray, vectors: np.ndarray) -> None:
        if self.folder:
            deleted(self.spark, self.folder)
        self.state, self.folder, self.place, self.held, self.vectors = state, folder, place, held, vectors

    def minimize(self, tolerance: float, max_steps: int) -> tuple[int, bool]:
        """As :func:`minimize`: (steps, whether the gradient fell below ``tolerance``)."""
        new, value, peak, products = self._evaluated(np.zeros(1), remember=False)
        self._take(*new)
        for step in range(max_steps):
            if peak <= tolerance:
                return step, True
            way, length = descent(products, 1 / self.scale), 1.0
            fall = products[0] @ way
            while True:
                new, new_value, peak, new_products = self._evaluated(length * way)
                if new_value <= value - 1e-4 * length * fall + 1e-13 * abs(value) or length < 1e-9:
                    break
                deleted(self.spark, new[1])
                length /= 2
            self._take(*new)
            value, products = new_value, new_products
            # what shuffles of earlier steps left on disk goes with the plans that made them
            if step % 8 == 7:
                self.spark.sparkContext._jvm.System.gc()
        return max_steps, False

    def words(self) -> DataFrame:
        width, per_chunk, often, held = self.width, self.per_chunk, self.often, self.held

        def named(words: pa.Table, state: pa.Table) -> pa.Table:
            chunk, terms = state.column("chunk")[0].as_py(), np.asarray(words.column("term"))
            own = np.frombuffer(state.column("at")[0].as_py()).reshape(-1, width)[terms - chunk * per_chunk]
            known = np.isin(terms, often)
            own[known] = held[np.searchsorted(often, terms[known])]
            offsets = np.arange(0, own.size + 1, width, dtype=np.int32)
            return pa.table([words.column("token"), words.column("idf"), pa.ListArray.from_arrays(offsets, own.ravel())], names=["token", "idf", "weights"])

        listed = self.vocabulary.select("token", "idf", "term", F.floor(F.col("term") / per_chunk).cast("int").alias("chunk"))
        # without words there is a chunk, but an empty one
        own = self.state.select("chunk", "at").join(F.broadcast(listed.agg(F.max("chunk").alias("_last"))), F.col("chunk").between(0, F.col("_last"))).drop("_last")
        return written(listed.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(named, "token string, idf double, weights array<double>"), "lr-weights")

    def bias(self) -> tuple[float, ...]:
        return tuple(self.held[-1].tolist())

    def close(self) -> None:
        self.rows.unpersist()
        deleted(self.spark, self.folder)


def _vectors(counts: DataFrame, key: str, words: DataFrame, small: bool) -> DataFrame:
    """(key, rare, terms, values): tf-idf of the known words, scaled to length one, and the rarest of them with its idf."""
    weighted = lookup_join(counts, words, "token", "left", small=small)
    entry = F.when(F.col("term").isNotNull(), F.struct("term", (F.col("n") * F.col("idf")).alias("x")))
    rarest = F.max(F.when(F.col("term").isNotNull(), F.struct("idf", "term")))
    gathered = weighted.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("v"), rarest.alias("rare"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + e["x"] * e["x"]))
    # once per text, not again for each of its words
    return compute_once(gathered, {"l": length}).select(
        key, "rare", F.transform("v", lambda e: e["term"].cast("int")).alias("terms"),
        F.transform("v", lambda e: e["x"] / F.col("l")).alias("values"))


def fit_text_labels_lr(
    train: DataFrame, key: str, text: str, heads: list[Head], regularization: float = REGULARIZATION,
    tolerance: float = TOLERANCE, max_steps: int = 500, min_texts: int = 1,
) -> LinearTextModel:
    """Logistic regression on tf-idf vectors of length one, and a bias, for all heads at once.

    Minimizes the mean over the texts of the summed losses of all heads, plus ``regularization`` / 2 times
    the sum of all squared weights, bias included: softmax over the classes of a single-label head, one
    sigmoid per tag of a multi-label head. Every word of the training texts has its own weight, unless
    ``min_texts`` asks that it occur in more texts. ``key`` is unique per text; a null text has no words.
    The weights are one matrix on the driver up to ``DRIVER_WEIGHT_BYTES``, and dealt to tasks beyond that; where they would take
    more than ``MOST_WEIGHT_BYTES`` nothing is fitted and a larger ``min_texts`` has to be chosen.
    """
    members, offset = [], 0
    for head in heads:
        members.append(head.members(offset))
        offset += head.size
    # what labels the texts is computed once
    train = written(train.select(key, text, F.array_compact(F.concat(*members)).cast("array<int>").alias("classes")), "lr-texts")
    counts = written(term_counts(train, key, text, text_parts(train, text)), "lr-terms")
    width, n = sum(h.size for h in heads), train.count()
    df = counts.where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_texts)
    vocabulary = written(dense_positions(
        df.select("token", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")), "token", "term"), "lr-vocabulary")
    size = vocabulary.count()
    if (size + 1) * width * 8 > MOST_WEIGHT_BYTES:
        raise ValueError(f"{size} words and {width} classes are too large a matrix of weights; raise min_texts")
    rows = written(_vectors(counts, key, vocabulary, small_enough(vocabulary)).join(train.select(key, "classes"), key).select(
        F.xxhash64(key).alias("hash"), "rare", "terms", "values", "classes"), "lr-rows")
    kinds = tuple(heads)
    if (size + 1) * width * 8 > DRIVER_WEIGHT_BYTES:
        fit = DealtFit(rows, vocabulary, kinds, size, n, regularization)
        steps, done = fit.minimize(tolerance, max_steps)
        if not done:
            warnings.warn(f"logistic regression stopped after {max_steps} steps, short of its tolerance", stacklevel=2)
        words, bias = fit.words(), fit.bias()
        fit.close()
        return LinearTextModel(words, bias, kinds, steps, small_enough(words))
    rows = rows.select("terms", "values", "classes")

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = summed_gradient(rows, weights, kinds)
        return loss / max(n, 1) + regularization / 2 * float((weights * weights).sum()), gradient / max(n, 1) + regularization * weights

    weights, steps, done = minimize(evaluate, np.zeros((size + 1, width)), tolerance, max_steps)
    if not done:
        warnings.warn(f"logistic regression stopped after {max_steps} steps, short of its tolerance", stacklevel=2)
    held = train.sparkSession.sparkContext.broadcast(weights)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = held.value[np.asarray(batch.column("term"))]
            offsets = np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("token"), batch.column("idf"), pa.ListArray.from_arrays(offsets, own.ravel())], ["token", "idf", "weights"])

    words = written(vocabulary.select("token", "idf", "term").mapInArrow(
        named, "token string, idf double, weights array<double>"), "lr-weights")
    return LinearTextModel(words, tuple(weights[-1].tolist()), kinds, steps, small_enough(words))


def predict_text_labels_lr(
    model: LinearTextModel, texts: DataFrame, key: str, text: str, counts: DataFrame | None = None,
) -> DataFrame:
    """One array of logits per head, as from ``predict_text_labels``. Words that the model has not seen are
    left out; a text without a known word has the biases. ``counts`` are the texts' ``term_counts``."""
    counts = term_counts(texts, key, text) if counts is None else counts
    weighted = lookup_join(counts, model.words, "token", "left", small=model.small)
    x = F.col("n") * F.col("idf")
    sums = weighted.groupBy(key).agg(F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0))).alias("_l"), *[
        F.coalesce(F.sum(x * F.get("weights", F.lit(i))), F.lit(0.0)).alias(f"_s{i}") for i in range(len(model.bias))])
    columns, at = [], 0
    for head in model.heads:
        columns.append(F.array(*[
            F.coalesce(F.try_divide(F.col(f"_s{i}"), "_l"), F.lit(0.0)) + F.lit(model.bias[i]) for i in range(at, at + head.size)
        ]).alias(head.name))
        at += head.size
    return sums.select(key, *columns)


# --- relevance of question/name pairs ---------------------------------------------------------

PAIR_REGULARIZATION = 0.001


@dataclass(frozen=True)
class PairModel:
    """Weights of a constant and of the pair features; ``steps`` counts the Newton steps."""

    weights: tuple[float, ...]
    steps: int


def fit_pair_relevance(
    features: DataFrame, label: str = "label", regularization: float = PAIR_REGULARIZATION,
    tolerance: float = 1e-12, max_steps: int = 100,
) -> PairModel:
    """Logistic regression from pair features to a relevance of 0 or 1, by Newton's method.

    Pairs are first reduced to distinct features and labels with counts, of which there are few. A step is one
    aggregate of the gradient and the upper half of the second derivatives, and a system of four equations.
    Minimizes the mean loss plus ``regularization`` / 2 times the squared weights without the constant.
    """
    rows = written(features.where(F.col(label).isNotNull()).groupBy(*PAIR_FEATURES, F.col(label).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).alias("_n")), "distinct-features")
    inputs = [F.lit(1.0), *map(F.col, PAIR_FEATURES)]
    size = len(inputs)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    penalty = np.diag([0.0] + [regularization] * (size - 1))
    weights, best = np.zeros(size), math.inf

    def evaluate(w: np.ndarray):
        margin = sum((x * float(c) for x, c in zip(inputs, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-margin))
        loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - F.col("_y") * margin
        total = rows.select("_n", "_y", margin.alias("_m"), p.alias("_p"), loss.alias("_l"), *PAIR_FEATURES).agg(
            F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_l")).alias("loss"),
            *[F.sum(F.col("_n") * (F.col("_p") - F.col("_y")) * x).alias(f"g{i}") for i, x in enumerate(inputs)],
            *[F.sum(F.col("_n") * F.col("_p") * (1 - F.col("_p")) * inputs[i] * inputs[j]).alias(f"h{i}{j}") for i, j in upper],
        ).first()
        if not total.n:
            return 0.0, np.zeros(size), np.eye(size)
        second = np.zeros((size, size))
        for i, j in upper:
            second[i, j] = second[j, i] = total[f"h{i}{j}"] / total.n
        gradient = np.array([total[f"g{i}"] for i in range(size)]) / total.n + penalty @ w
        return total.loss / total.n + w @ penalty @ w / 2, gradient, second + penalty

    value, gradient, second = evaluate(weights)
    for step in range(1, max_steps + 1):
        move = np.linalg.lstsq(second, gradient, rcond=None)[0]
        length = 1.0
        while True:
            there = weights - length * move
            new = evaluate(there)
            if new[0] <= value + 1e-13 * abs(value) or length < 1e-6:
                break
            length /= 2
        weights, best = there, np.abs(length * move).max()
        value, gradient, second = new
        if best <= tolerance:
            return PairModel(tuple(weights.tolist()), step)
    warnings.warn(f"pair relevance stopped after {max_steps} steps, short of its tolerance", stacklevel=2)
    return PairModel(tuple(weights.tolist()), max_steps)


def score_pair_relevance(model: PairModel, features: DataFrame) -> DataFrame:
    """Add ``score``, the probability that the name is relevant to the question."""
    margin = sum((F.col(x) * c for x, c in zip(PAIR_FEATURES, model.weights[1:])), F.lit(model.weights[0]))
    return features.withColumn("score", 1 / (1 + F.exp(-margin)))
