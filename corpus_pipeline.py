"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hintwise.llm import decontamination, language_id, mixing, simhash, token_output
from hintwise.operators.scaling import scratch, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: those without a letter, and those
    that no learned language explains. The model learns from the stage's own labelled documents. Null and empty
    texts go; very long ones are read whole; ties go to the first language by name; repeated rows stay or go together; an empty table gives none."""
    model = language_id.fit(docs.where("lang IS NOT NULL"))
    return language_id.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links join: fingerprints of three-word shingles that differ in
    three bits or less. The least id stays, null being the greatest; of repeated rows one stays. Null and empty texts are copies
    of each other; very long ones are read whole; an empty table gives none; other columns travel along."""
    return simhash.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs. Null and empty texts have none; very long ones
    are read whole; repeated rows stay or go together; an empty benchmark drops nothing; other columns travel along."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Null and empty texts have no words and are taken as their hash says;
    ties of the hash go together; repeated rows are documents of their own; an empty table gives none."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold. Null and empty texts have the end mark only; rows of one id follow
    each other; very long texts are encoded whole; an empty table gives no rows and no ids."""
    return token_output.encoded_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
# hashes, models and tokenizers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what a stage wrote for
    itself is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
