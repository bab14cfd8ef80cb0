"""Metrics. Each is one aggregation whose result is a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.functions.vectors import binary_cross_entropy, cosine, cross_entropy, log_sum_exp
from hintwise.operators.scaling import average_ranks, lookup_join, written
from hintwise.schemas import LOSS_WEIGHTS


def _long(one_row: DataFrame, metric: str, heads: list[str]) -> DataFrame:
    entries = F.explode_outer(F.array(*[
        F.struct(F.lit(h).alias("head"), F.lit(metric).alias("metric"), F.col(h).alias("value"))
        for h in heads
    ]))
    return one_row.select(entries.alias("e")).select("e.*")


def accuracy(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    """``(head, metric, value)``; ``heads`` maps a head to its (prediction, truth) columns."""
    row = df.agg(*[
        F.avg((F.col(p) == F.col(t)).cast("double")).alias(h) for h, (p, t) in heads.items()
    ])
    return _long(row, "accuracy", list(heads))


def row_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two tag sets of one row; 0 where a denominator is 0. Precision and recall cancel
    to twice the shared tags over all tags."""
    shared = F.size(F.array_intersect(predicted, truth))
    return F.coalesce(F.try_divide(2.0 * shared, F.size(predicted) + F.size(truth)), F.lit(0.0))


def sample_f1(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    row = df.agg(*[F.avg(row_f1(F.col(p), F.col(t))).alias(h) for h, (p, t) in heads.items()])
    return _long(row, "sample_f1", list(heads))


def combined_score(metrics: DataFrame) -> DataFrame:
    """Mean over the heads of their score."""
    return metrics.agg(F.avg("value").alias("value")).select(
        F.lit("all").alias("head"), F.lit("combined").alias("metric"), "value"
    )


def exact_match(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows in which every head is right."""
    right = F.lit(True)
    for p, t in heads.values():
        right = right & (F.col(p) == F.col(t))
    return df.agg(F.avg(right.cast("double")).alias("value")).select(
        F.lit("all").alias("head"), F.lit("exact_match").alias("metric"), "value"
    )


def mean_accuracy(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    return accuracy(df, heads).agg(F.avg("value").alias("value")).select(
        F.lit("all").alias("head"), F.lit("mean_accuracy").alias("metric"), "value"
    )


def _class_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision, recall, F1 and support of every class among truths and predictions. Each row
    counts once for its true and once for its predicted class; no join."""
    right = (F.col(predicted) == F.col(truth)).cast("int")
    votes = F.explode_outer(F.array(
        F.struct(F.col(truth).cast("string").alias("class"), F.lit(1).alias("is_true"),
                 F.lit(0).alias("is_pred"), right.alias("hit")),
        F.struct(F.col(predicted).cast("string").alias("class"), F.lit(0).alias("is_true"),
                 F.lit(1).alias("is_pred"), F.lit(0).alias("hit")),
    ))
    counts = df.select(votes.alias("v")).groupBy("v.class").agg(
        F.sum("v.is_true").alias("support"), F.sum("v.is_pred").alias("guessed"), F.sum("v.hit").alias("hits")
    )

    def ratio(top, bottom) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return counts.select(
        "class", "support", "hits",
        ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"),
    )


def classification_report(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """``(kind, class, precision, recall, f1, support)``: one line per class (kind ``class``), plus
    accuracy (under f1), macro and weighted averages (kind ``summary``), which are further groups of
    the same small table. A class may have the name of a summary."""
    scores = _class_scores(df, predicted, truth)
    lines = F.explode_outer(F.array(
        F.struct(F.lit("class").alias("kind"), F.col("class").alias("name"), F.lit(1.0).alias("w")),
        F.struct(F.lit("summary").alias("kind"), F.lit("accuracy").alias("name"), F.lit(0.0).alias("w")),
        F.struct(F.lit("summary").alias("kind"), F.lit("macro avg").alias("name"), F.lit(1.0).alias("w")),
        F.struct(F.lit("summary").alias("kind"), F.lit("weighted avg").alias("name"), F.col("support").cast("double").alias("w")),
    ))
    spread = scores.select("*", lines.alias("line"))

    def mean(column: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(column) * F.col("line.w")), F.sum("line.w")))

    is_accuracy = (F.col("kind") == "summary") & (F.col("class") == "accuracy")
    return spread.groupBy(F.col("line.kind").alias("kind"), F.col("line.name").alias("class")).agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"),
        mean("f1").alias("f1"), F.sum("support").alias("support"), F.sum("hits").alias("hits"),
    ).select(
        "kind", "class", "precision", "recall",
        F.when(is_accuracy, F.try_divide(F.col("hits"), F.col("support"))).otherwise(F.col("f1")).alias("f1"),
        "support",
    )


def weighted_prf(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Support-weighted precision, recall and F1 in one row."""
    scores = _class_scores(df, predicted, truth)

    def weighted(column: str) -> Column:
        return F.try_divide(F.sum(F.col(column) * F.col("support")), F.sum("support")).alias(column)

    return scores.agg(weighted("precision"), weighted("recall"), weighted("f1"))


def multi_output_log_loss(
    df: DataFrame, single: dict[str, tuple[str, str]], multi: dict[str, tuple[str, str]],
    weights: dict[str, float] = LOSS_WEIGHTS,
) -> DataFrame:
    """Mean cross entropy per single-label head, mean binary cross entropy per multi-label head
    and their weighted sum. Columns are (logits, truth); the truth is a class index or a 0/1
    vector."""
    losses = {h: F.avg(cross_entropy(F.col(x), F.col(t))) for h, (x, t) in single.items()}
    losses |= {h: F.avg(binary_cross_entropy(F.col(x), F.col(t))) for h, (x, t) in multi.items()}
    row = df.agg(*[loss.alias(h) for h, loss in losses.items()])
    total = sum((F.col(h) * weights[h] for h in losses), F.lit(0.0))
    return _long(row.withColumn("total", total), "log_loss", [*losses, "total"])


def info_nce(
    triplets: DataFrame, vectors: DataFrame, temperature: float = 0.07
) -> DataFrame:
    """Mean of -log(exp(p/t) / (exp(p/t) + sum exp(n/t))) over the questions.

    ``triplets(query_id, vec, positive, negatives)``, ``vectors(table, vec)``. A missing positive
    and missing negatives (up to the largest number of negatives of any question, at least one)
    count as zero vectors, similarity 0.
    """
    tables = F.explode_outer(F.array_union(F.array("positive"), "negatives"))
    met = lookup_join(
        triplets.select("query_id", "vec", "positive", F.size("negatives").alias("n"), tables.alias("table")),
        vectors.withColumnRenamed("vec", "table_vec"), "table", "left",
    ).withColumn(
        "logit", F.coalesce(cosine(F.col("vec"), F.col("table_vec")), F.lit(0.0)) / temperature
    )
    # a group is one question: its positive and its few negatives
    per_query = met.groupBy("query_id").agg(
        F.max("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("table") == F.col("positive"), F.col("logit"))), F.lit(0.0)).alias("p"),
        F.collect_list(F.when(
            F.coalesce(F.col("table") != F.col("positive"), F.lit(False)) | (
                F.col("positive").isNull() & F.col("table").isNotNull()), F.col("logit"))).alias("neg"),
    )
    most = triplets.agg(F.greatest(F.max(F.size("negatives")), F.lit(1)).alias("m")).scalar()
    padding = F.array_repeat(F.lit(0.0), most - F.col("n"))
    padded = per_query.select("p", F.concat(F.array("p"), "neg", padding).alias("logits"))
    loss = log_sum_exp(F.col("logits")) - F.col("p")
    return padded.agg(F.avg(loss).alias("value")).select(
        F.lit("ranker").alias("head"), F.lit("info_nce").alias("metric"), "value"
    )


def cosine_mse(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of ``score`` and ``label``."""
    return pairs.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("value")).select(
        F.lit("ranker").alias("head"), F.lit("cosine_mse").alias("metric"), "value"
    )


def score_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of ``score`` with ``label``.

    The pairs are first counted per (score, label), so equal scores, however many, weigh one
    row. Spearman is the correlation of average ranks, whose mean is (n + 1) / 2.
    """
    counted = written(
        pairs.groupBy("score", "label").agg(F.count(F.lit(1)).alias("n")), "score-counts"
    )
    score_ranks = average_ranks(counted, "score", "n").withColumnRenamed("rank", "score_rank")
    label_ranks = average_ranks(counted, "label", "n").withColumnRenamed("rank", "label_rank")
    ranked = lookup_join(lookup_join(counted, score_ranks, "score"), label_ranks, "label")
    means = counted.agg(F.struct(
        F.try_divide(F.sum(F.col("score") * F.col("n")), F.sum("n")).alias("score"),
        F.try_divide(F.sum(F.col("label") * F.col("n")), F.sum("n")).alias("label"),
        ((F.sum("n") + 1) / 2).alias("rank"),
    ).alias("m"))

    def correlation(x: Column, y: Column) -> Column:
        n = F.col("n")
        return F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x) * F.sum(n * y * y)))

    m = ranked.withColumn("m", means.scalar())
    row = m.agg(
        correlation(F.col("score") - F.col("m.score"), F.col("label") - F.col("m.label")).alias("pearson"),
        correlation(F.col("score_rank") - F.col("m.rank"), F.col("label_rank") - F.col("m.rank")).alias("spearman"),
    )
    entries = F.explode_outer(F.array(*[
        F.struct(F.lit("ranker").alias("head"), F.lit(c).alias("metric"), F.col(c).alias("value"))
        for c in ("pearson", "spearman")
    ]))
    return row.select(entries.alias("e")).select("e.*")


def hits_at_k(hints: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, found, total)``: hints in the first k whose name contains an expected name,
    and the number of expected names. ``expected(query_id, expected ARRAY<STRING>)``."""
    top = hints.where(F.col("rank") <= k).select("query_id", "table")
    hit = F.exists("expected", lambda e: F.col("table").contains(e))
    return expected.join(top, "query_id", "left").groupBy("query_id").agg(
        F.count_if(F.coalesce(hit, F.lit(False))).alias("found"),
        F.max(F.size("expected")).cast("bigint").alias("total"),
    )


def recall_at_k(hints: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, recall)``: the mean over questions of the share of expected tables, by exact name,
    within the first k. ``expected(query_id, table)``."""
    places = hints.where(F.col("rank") <= max(ks)).groupBy("query_id", "table").agg(F.min("rank").alias("rank"))
    shares = expected.join(places, ["query_id", "table"], "left").groupBy("query_id").agg(*[
        F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"r{k}") for k in ks
    ])
    row = shares.agg(*[F.avg(f"r{k}").alias(f"r{k}") for k in ks])
    entries = F.explode_outer(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks
    ]))
    return row.select(entries.alias("e")).select("e.*")
