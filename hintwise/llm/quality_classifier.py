"""A quality classifier: random Fourier features, ridge regression and isotonic calibration.

Statistics of each text are standardised and mapped to random cosines, whose inner products
approximate a Gaussian kernel. Partitions sum their part of the normal equations; the driver solves
one small system. Scores are calibrated by isotonic regression on labelled texts kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import let
from hintwise.llm.quality_rules import text_statistics
from hintwise.operators.scaling import compute_once, written

INPUTS = 11
FEATURES = 192
WIDTH = 2.0
RIDGE = 1e-3
BINS = 1000
SEED = 7


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the inputs of the classifier, all from the text; a null text counts as empty."""
    def inputs(s, t):
        n = F.greatest(s["n_words"], F.lit(1))
        lines = F.greatest(s["n_lines"], F.lit(1))
        chars = F.greatest(s["word_chars"], F.lit(1))
        upper = F.char_length(F.regexp_replace(t, r"[^A-Z]+", ""))
        digits = F.char_length(F.regexp_replace(t, r"[^0-9]+", ""))
        return F.array(
            F.log1p(s["n_words"]), s["word_chars"] / n, F.sqrt(s["n_symbols"] / n), F.sqrt(s["n_exclamations"] / n),
            s["n_stop_words"] / n, F.log1p(n / lines), s["n_dup_lines"] / lines, s["n_repeat_words"] / n,
            s["n_ellipsis_lines"] / lines, F.sqrt(upper / chars), F.sqrt(digits / chars),
        )

    x = let(F.coalesce("text", F.lit("")), lambda t: let(text_statistics(t), lambda s: inputs(s, t)))
    return compute_once(docs.select("doc_id", "text"), {"x": x}).select("doc_id", "x")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # lower ends of the calibrated pieces, ascending
    values: np.ndarray  # their values, not descending

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = ((x - self.mean) / self.scale) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, bins(self.raw(x)), side="right") - 1
        return self.values[np.maximum(at, 0)]


def bins(raw: np.ndarray) -> np.ndarray:
    """Raw scores in steps of 1 / BINS, from -0.5 to 1.5."""
    return np.clip(np.floor((raw + 0.5) * BINS), 0, 2 * BINS).astype(np.int64)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that does not descend, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else np.zeros(0)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, width))


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """[k, k + 1]: sums of z z' and z y over (x, y). A partition emits its sums, one row per line of
    the matrix; lines are added up in as many groups."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            z = model.cosines(_matrix(batch["x"], len(model.mean)))
            own = z.T @ np.column_stack([z, batch["y"].to_numpy(float)])
            total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"line": np.arange(len(total)), "sums": list(total)})

    def added(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": lines["line"].iloc[:1], "sums": [np.sum(np.stack(lines["sums"].to_list()), axis=0)]})

    schema = "line int, sums array<double>"
    k = len(model.phases) + 1
    out = np.zeros((k, k + 1))
    for r in rows.select("x", "y").mapInPandas(part, schema).groupBy("line").applyInPandas(added, schema).collect():
        out[r.line] = r.sums
    return out


def fit(inputs: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """Fit on all of (doc_id, x) that have a label in (doc_id, quality). A fifth of them by a hash
    of the id only calibrates. Rows without id or label teach nothing; several labels of a document
    all count. Only sums, one matrix and one histogram, come to the driver."""
    labelled = written(inputs.join(labels.where("quality IS NOT NULL"), "doc_id").select(
        "x", F.col("quality").cast("double").alias("y"),
        (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(5)) == 0).alias("apart"),
    ), "quality-labels")
    size = INPUTS
    moments = labelled.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    mean, scale = np.zeros(size), np.ones(size)
    for r in moments:
        mean[r.pos], scale[r.pos] = r.m, max(r.s or 0.0, 1e-6)
    rng = np.random.default_rng(SEED)
    model = Model(
        mean, scale, rng.normal(0, 1 / width, (size, features)) / np.sqrt(size) * 2, rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.zeros(1, np.int64), np.full(1, 0.5),
    )
    if not moments:
        return model
    sums = normal_equations(labelled.where("NOT apart"), model)
    n = max(sums[-1, -2], 1.0)
    model.weights = np.linalg.solve(sums[:, :-1] / n + ridge * np.diag([*[1.0] * features, 1e-9]), sums[:, -1] / n)

    @F.pandas_udf("bigint")
    def binned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(bins(model.raw(_matrix(x, size))))

    apart = labelled.where("apart")
    if apart.isEmpty():
        apart = labelled
    counts = apart.groupBy(binned("x").alias("bin")).agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.cuts = np.array([r.bin for r in counts], np.int64)
    model.values = np.clip(isotonic(np.array([r.y for r in counts]), np.array([r.n for r in counts], float)), 0, 1)
    return model


def predict(inputs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), one row per row of (doc_id, x); predicted is 1 from ``threshold``.
    Repeated rows give repeated results; an empty table gives none; a model without labels gives 0.5."""
    size = len(model.mean)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(_matrix(x, size)))

    return inputs.select("doc_id", scored("x").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
