"""Scans: query logs, question/table/SQL corpora, catalog lists and label dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hintwise.functions.text import extract_prompt, extract_prompt_strict, strip
from hintwise.schemas import LABEL_DICT, NULL_TOKENS, QA_CORPUS, QUERY_LOG, QUERY_LOG_PLAIN

# why a request is refused
BLANK_QUERY, NO_TABLES = "blank_query", "no_tables"
SPLIT_FILES = {"train": "train", "val": "validation"}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """CSV with header, doubled quotes and newlines inside cells, never inferring types.

    Columns are found by their header names, whatever their order; all of them are text. With a
    ``schema`` only its columns are kept, cast to its types, and a missing one is an error. Files
    of one folder must have the same header.

    Cells may hold line breaks, so a file is not split: the parallelism is the number of files.
    Callers who know that no cell holds one pass ``multi_line=False``, and files are split. For
    repeated use convert once to parquet with :func:`hintwise.sources.writers.write_split`.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("enforceSchema", False)
        .option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if schema is not None:
        require(raw, [f.name for f in schema.fields])
        raw = raw.select(*[named(raw, f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return null_tokens_to_null(raw)


def named(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; the file has {', '.join(df.columns)}")


def with_row_key(df: DataFrame, key: str) -> DataFrame:
    """Add ``key``: the md5 of a row's content and its number among exact duplicates.

    Duplicates are counted before they are numbered, so a row repeated any number of times is one
    row of the shuffle. The key depends on nothing but the content of the table.
    """
    content = F.md5(F.to_json(F.struct(*[named(df, c) for c in df.columns]), {"ignoreNullFields": "false"}))
    counted = df.groupBy(*[named(df, c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_times"))
    numbered = counted.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_number"))
    return numbered.select(F.concat_ws("-", content, "_number").alias(key), *[named(df, c) for c in df.columns])


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Turn the cells that stand for a missing value into nulls, in all text columns."""
    return df.select(*[
        F.when(F.col(f.name).isin(NULL_TOKENS), None).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def normalize_query_log(raw: DataFrame) -> DataFrame:
    """Either layout of a log to ``(…, instruction, sql)``.

    ``structured_input`` + ``sql`` has its question cut out of the prompt;
    ``instruction`` + ``query`` only has its query renamed.
    """
    if "structured_input" in raw.columns:
        return raw.withColumn("instruction", extract_prompt(F.col("structured_input")))
    return raw.withColumnRenamed("query", "sql")


def _read_log(spark: SparkSession, path: str, schema: T.StructType | None, multi_line: bool) -> DataFrame:
    """A log with the columns of the layout that its header shows, and a ``query_id``: the file's
    own number, or a row key."""
    raw = read_csv(spark, path, None, multi_line)
    layout = QUERY_LOG if "structured_input" in raw.columns else QUERY_LOG_PLAIN
    if schema is not None and "structured_input" not in raw.columns and "structured_input" in schema.names:
        require(raw, schema.names)
    has_key = "query_id" in raw.columns
    names = [n for n in layout.names if n != "query_id" or has_key]
    if "query" in names and "query" not in raw.columns and "sql" in raw.columns:
        names[names.index("query")] = "sql"
    require(raw, names)
    raw = raw.select(*[named(raw, n) for n in names])
    return raw.withColumn("query_id", F.col("query_id").cast("bigint")) if has_key else with_row_key(raw, "query_id")


def read_query_log(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """A query log of either layout, found from the header of the file; extra columns are left
    out. ``schema`` only asks for the layout: a log without its columns is refused."""
    return normalize_query_log(_read_log(spark, path, schema, multi_line))


def ranking_corpus(raw: DataFrame) -> DataFrame:
    """Log rows with a non-empty question for table ranking. Here a structured prompt without
    its marker is no question, unlike in :func:`normalize_query_log`."""
    if "structured_input" in raw.columns:
        question = extract_prompt_strict(F.col("structured_input"))
    else:
        question = F.col("instruction")
    sql: Column = F.lit("")
    for name in ("query", "sql"):
        if name in raw.columns:
            sql = F.col(name)
    return raw.withColumns({"instruction": question, "sql": sql}).where(F.col("instruction") != "")


def read_ranking_corpus(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    return ranking_corpus(_read_log(spark, path, schema, multi_line))


def read_qa_corpus(spark: SparkSession, root: str, split: str, multi_line: bool = True) -> DataFrame:
    """One split of a question/table/SQL corpus; any other name than train or val means test. A
    corpus without ``row_id`` gets row keys."""
    name = SPLIT_FILES.get(split, "test")
    raw = read_csv(spark, f"{root}/{name}.csv", None, multi_line)
    names = [n for n in QA_CORPUS.names if n != "row_id"]
    require(raw, names)
    kept = raw.select(*[named(raw, n) for n in (["row_id"] if "row_id" in raw.columns else []) + names])
    keyed = kept if "row_id" in kept.columns else with_row_key(kept, "row_id")
    return keyed.withColumn("split", F.lit(split if split in SPLIT_FILES else "test"))


def read_qa_splits(spark: SparkSession, root: str) -> DataFrame:
    train, val, test = (read_qa_corpus(spark, root, s) for s in ("train", "val", "test"))
    return train.unionByName(val).unionByName(test)


def parse_catalog_list(df: DataFrame, text: str) -> DataFrame:
    """Delimited text to one row per entry with its position. The pipe separates if there is
    one, else the comma; entries are stripped and empty ones dropped."""
    column = F.col(text)
    pieces = F.when(column.contains("|"), F.split(column, r"\|")).otherwise(F.split(column, ","))
    entries = F.filter(F.transform(pieces, strip), lambda e: e != "")
    return df.select("*", F.posexplode_outer(entries).alias("entry_pos", "table")).where(
        "table IS NOT NULL"
    )


def validate_requests(requests: DataFrame, need_tables: bool = False) -> DataFrame:
    """Add ``reason``: null for a usable request, else why it is refused.

    ``query`` must not be blank; with ``need_tables`` the array ``tables`` must not be empty.
    """
    reason = F.when(F.coalesce(strip(F.col("query")), F.lit("")) == "", BLANK_QUERY)
    if need_tables:
        reason = reason.when(F.coalesce(F.size("tables"), F.lit(0)) <= 0, NO_TABLES)
    return requests.withColumn("reason", reason)


def split_requests(requests: DataFrame, need_tables: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; an empty frame of requests is itself an error."""
    if requests.isEmpty():
        raise ValueError("no_requests")
    checked = validate_requests(requests, need_tables)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def read_label_dict(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_DICT).parquet(path)


