"""Column functions on ARRAY<FLOAT|DOUBLE> vectors and on arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hintwise.functions.text import let


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(array_sum(F.transform(as_double(vector), lambda x: x * x)))


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(as_double(left), as_double(right), lambda x, y: x * y))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors of one row; 0 when either is all zeros."""
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(
        F.greatest(norm(vector), F.lit(1e-12)),
        lambda length: F.transform(as_double(vector), lambda x: x / length),
    )


def argmax(logits: Column) -> Column:
    """0-based position of the largest value, the lower one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def _powers(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))


def softmax(logits: Column) -> Column:
    return let(_powers(logits), lambda powers: let(
        array_sum(powers), lambda total: F.transform(powers, lambda p: p / total)
    ))


def log_sum_exp(logits: Column) -> Column:
    return F.array_max(logits) + F.log(array_sum(_powers(logits)))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def cross_entropy(logits: Column, truth: Column) -> Column:
    """Minus log softmax of the true class (0-based)."""
    return log_sum_exp(logits) - F.get(logits, truth)


def binary_cross_entropy(logits: Column, truth: Column) -> Column:
    """Mean over the tags of max(x,0) - x*y + log(1 + exp(-|x|))."""
    terms = F.zip_with(
        logits, truth,
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return array_sum(terms) / F.size(logits)
