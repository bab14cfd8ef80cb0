"""One query per corpus operator, over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise.llm import (
    conversation_repair, decontamination, filter_audit, language_id, licenses, minhash, mixing,
    quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_output,
)
from hintwise.operators.scaling import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op3_quality_classifier(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    inputs = written(quality_classifier.statistics(table(spark, sf_dir, "documents")), "quality-inputs")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    model = quality_classifier.fit(inputs, labels)
    return quality_classifier.predict(inputs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


@query
def op4_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string")))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 6).alias("best_dice"),
        F.array_join(spans, ",").alias("passages"),
    )


@query
def op5_decontaminate(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_token_files(spark, sf_dir):
    return token_output.encoded_documents(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    model = language_id.fit(docs.where(~held_out & F.col("lang").isNotNull()))
    return language_id.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


@query
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op9_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.fit_ratio(secrets.labelled_samples(docs))
    return secrets.digest(secrets.scan(docs, ratios))


@query
def op10_simhash_groups(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_minhash_groups(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.digest(conversation_repair.repair(conversation_repair.damaged(rows)))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select("conv_id").distinct().alias("o").join(
        found.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "o.conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")
