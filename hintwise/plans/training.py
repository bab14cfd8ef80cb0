"""From a raw query log to a fitted and evaluated analyzer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit
from hintwise.operators import decoding, evaluation
from hintwise.operators.encoding import multi_hot
from hintwise.operators.labelling import label_query_log
from hintwise.operators.sampling import split_train_val_test
from hintwise.operators.textmodel import Head, TextModel, fit_text_labels, predict_text_labels
from hintwise.schemas import HEAD_COLUMNS, MULTI_HEADS, SINGLE_HEADS


def analyzer_heads() -> list[Head]:
    return [Head(h, f"{h}_y", len(c)) for h, c in SINGLE_HEADS.items()] + [
        Head(h, f"{h}_y", len(c), multi=True) for h, c in MULTI_HEADS.items()
    ]


def with_targets(labelled: DataFrame) -> DataFrame:
    """Add the class index or 0/1 vector of every head in declared class order."""
    single = {
        f"{h}_y": (F.array_position(array_lit(classes), F.col(HEAD_COLUMNS[h])) - 1).cast("int")
        for h, classes in SINGLE_HEADS.items()
    }
    multi = {
        f"{h}_y": multi_hot(F.col(HEAD_COLUMNS[h]), classes) for h, classes in MULTI_HEADS.items()
    }
    return labelled.withColumns({**single, **multi})


def training_set(log: DataFrame, key: str = "query_id") -> DataFrame:
    """Labelled, encoded and split log; one narrow pass over ``log(query_id, instruction, sql)``."""
    return split_train_val_test(with_targets(label_query_log(log)), key)


def fit_analyzer(train: DataFrame, text: str = "instruction") -> TextModel:
    return fit_text_labels(train.where("split = 'train'"), text, analyzer_heads())


def evaluate_analyzer(model: TextModel, data: DataFrame, split: str = "test") -> DataFrame:
    """The five head scores and their mean on one split, ``(head, metric, value)``."""
    held = data.where(F.col("split") == split)
    logits = predict_text_labels(model, held, "query_id", "instruction")
    decoded = decoding.decode(logits)
    truth = held.select("query_id", *[F.col(c).alias(f"{c}_true") for c in HEAD_COLUMNS.values()])
    both = decoded.withColumnRenamed("estimated_tables", "table_count").join(truth, "query_id")
    single = {HEAD_COLUMNS[h]: (HEAD_COLUMNS[h], f"{HEAD_COLUMNS[h]}_true") for h in SINGLE_HEADS}
    multi = {HEAD_COLUMNS[h]: (HEAD_COLUMNS[h], f"{HEAD_COLUMNS[h]}_true") for h in MULTI_HEADS}
    metrics = evaluation.accuracy(both, single).unionByName(evaluation.sample_f1(both, multi))
    return metrics.unionByName(evaluation.combined_score(metrics))
