"""One query per operator over the star-schema and text tables: ``(spark, sf_dir) -> DataFrame``.

Arrays are joined to text and scores rounded to six digits, so that results can be compared
with another engine value by value.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise import schemas as S
from hintwise.functions import sql_labels as L
from hintwise.functions.text import extract_prompt, extract_prompt_strict
from hintwise.functions.vectors import cosine, l2_normalize
from hintwise.operators import (
    catalog, catalog_store, decoding, encoding, evaluation, hints, linear, pairs, profiling, ranking, sampling,
    textmodel,
)
from hintwise.operators.labelling import drop_unlabelled, label_query_log, with_referenced_tables
from hintwise.operators.scaling import shared_folder, written
from hintwise.plans import serving, training
from hintwise.sources import derived, readers, writers
from hintwise.streaming.analyze import analyze_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_query")] = f
    return f


def rounded(column: Column, digits: int = 6) -> Column:
    """Round for comparison. The shift moves values off exact halves, which engines round
    differently; adding 0.0 turns -0.0 into 0.0."""
    return F.round(column + F.lit(1e-10), digits) + F.lit(0.0)


def joined(column: Column | str, by: str = ",") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), by)


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    return readers.normalize_query_log(derived.raw_query_log(spark, sf))


def labelled_log(spark: SparkSession, sf: str) -> DataFrame:
    return label_query_log(log_of(spark, sf)).drop("structured_input")


def csv_log(log: DataFrame, columns: list) -> str:
    """The folder of a log that was written as CSV files with the given columns."""
    path = shared_folder(log.sparkSession, "query-log-csv")
    log.select(*columns).write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def by_content(log: DataFrame) -> DataFrame:
    """Rows of a log without ids by content: how many there are, and how many keys they got."""
    return log.groupBy("instruction", "sql").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_keys"))


@query
def read_query_log_csv(spark, sf):
    """A structured log from files without an id, its columns in another order and among others."""
    path = csv_log(derived.raw_query_log(spark, sf), [F.lit("x, \"y\"").alias("note"), "sql", F.lit(7).alias("extra"), "structured_input"])
    return by_content(readers.read_query_log(spark, path, S.QUERY_LOG))


@query
def read_plain_log_csv(spark, sf):
    """A plain log from such files."""
    log = log_of(spark, sf).select("instruction", "sql")
    path = csv_log(log, [F.col("sql").alias("query"), F.lit("x").alias("note"), "instruction"])
    return by_content(readers.read_query_log(spark, path))


def table_log(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the tables their statement refers to."""
    corpus = readers.ranking_corpus(derived.raw_query_log(spark, sf))
    return drop_unlabelled(with_referenced_tables(corpus)).select("query_id", "instruction", "tables")


def parsed_qa(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.with_qa_columns(pairs.filter_questions(derived.raw_qa_corpus(spark, sf)))


# --- sources and sinks ------------------------------------------------------------------------

def _csv_log(spark: SparkSession, sf: str) -> str:
    path = shared_folder(spark, "query-log-csv")
    writers.write_csv(derived.raw_query_log(spark, sf), path)
    return path


@query
def read_query_log(spark, sf):
    return readers.read_query_log(spark, _csv_log(spark, sf), S.QUERY_LOG).select(
        "query_id", "instruction", "sql"
    )


@query
def read_ranking_corpus(spark, sf):
    return readers.read_ranking_corpus(spark, _csv_log(spark, sf), S.QUERY_LOG).select(
        "query_id", "instruction", "sql"
    )


@query
def read_qa_corpus(spark, sf):
    root = shared_folder(spark, "qa-csv")
    corpus = sampling.split_train_val_test(derived.raw_qa_corpus(spark, sf), "row_id")
    for split, name in (("train", "train"), ("val", "validation"), ("test", "test")):
        writers.write_csv(corpus.where(F.col("split") == split).drop("split"), f"{root}/{name}.csv")
    return readers.read_qa_splits(spark, root)


def table_lists(spark, sf):
    """A delimited list of part names per order: by pipe or by comma, with blanks and gaps."""
    lines = derived.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set(F.concat_ws("_", F.lit(" part"), "l_partkey"))).alias("names")
    )
    return lines.select(
        F.col("l_orderkey").alias("query_id"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.array_join("names", " (a, b)|"), F.lit("| |")))
        .otherwise(F.concat(F.lit(","), F.array_join("names", " ,"))).alias("listed"),
    )


@query
def parse_catalog_list(spark, sf):
    return readers.parse_catalog_list(table_lists(spark, sf), "listed").select(
        "query_id", "entry_pos", "table"
    )


@query
def write_labelled(spark, sf):
    path = shared_folder(spark, "labelled")
    writers.write_split(sampling.split_train_val_test(labelled_log(spark, sf), "query_id"), path)
    return spark.read.parquet(path).select(
        "query_id", "complexity", joined("keywords").alias("keywords"), F.col("split")
    )


HEAD_CODES = {"complexity": "complexity", "category": "category", "table_count": "table_count"}


@query
def write_label_dict(spark, sf):
    path = shared_folder(spark, "label-dict")
    writers.write_label_dict(encoding.fit_label_dict(labelled_log(spark, sf), HEAD_CODES), path)
    return readers.read_label_dict(spark, path)


@query
def write_metrics(spark, sf):
    path = shared_folder(spark, "metrics")
    writers.write_metrics(accuracy(spark, sf), path, "run-1")
    return spark.read.schema("run_id string, head string, metric string, value double").json(path)


# --- filters and projections ------------------------------------------------------------------

@query
def extract_prompt_query(spark, sf):
    return derived.raw_query_log(spark, sf).select(
        "query_id", extract_prompt(F.col("structured_input")).alias("instruction")
    )


@query
def extract_prompt_strict_query(spark, sf):
    return derived.raw_query_log(spark, sf).select(
        "query_id", extract_prompt_strict(F.col("structured_input")).alias("instruction")
    ).where("instruction <> ''")


@query
def filter_questions(spark, sf):
    return pairs.filter_questions(derived.raw_qa_corpus(spark, sf)).select("row_id", "question")


@query
def extract_headers(spark, sf):
    return derived.raw_qa_corpus(spark, sf).select(
        "row_id", joined(pairs.extract_headers(F.col("table"))).alias("headers")
    )


@query
def extract_sql_columns(spark, sf):
    sql = F.col("sql")
    return derived.raw_qa_corpus(spark, sf).select(
        "row_id", pairs.selected_column(sql).alias("sel"), joined(pairs.condition_columns(sql)).alias("conds")
    )


@query
def relevant_indices(spark, sf):
    return parsed_qa(spark, sf).select("row_id", joined("relevant").alias("relevant"))


@query
def usable_qa_rows(spark, sf):
    return pairs.usable_qa_rows(parsed_qa(spark, sf)).select(
        "row_id", "question", "sel", joined("relevant").alias("relevant")
    )


@query
def validate_requests(spark, sf):
    requests = with_referenced_tables(log_of(spark, sf)).withColumnRenamed("instruction", "query")
    return readers.validate_requests(requests, need_tables=True).select("query_id", "query", "reason")


@query
def drop_unlabelled_query(spark, sf):
    return table_log(spark, sf).select("query_id", "instruction", joined("tables").alias("tables"))


# --- labels of SQL text -------------------------------------------------------------------------

@query
def sql_keywords(spark, sf):
    sql = F.col("sql")
    return log_of(spark, sf).select("query_id", joined(L.sql_keywords(sql)).alias("keywords"))


@query
def sql_complexity(spark, sf):
    return labelled_log(spark, sf).select("query_id", "complexity")


@query
def sql_table_count(spark, sf):
    return log_of(spark, sf).select("query_id", L.sql_table_count(F.col("sql")).alias("table_count"))


@query
def sql_category(spark, sf):
    return log_of(spark, sf).select("query_id", L.sql_category(F.col("sql")).alias("category"))


@query
def sql_subcategories(spark, sf):
    return labelled_log(spark, sf).select("query_id", joined("subcategories").alias("subcategories"))


@query
def referenced_tables(spark, sf):
    return log_of(spark, sf).select("query_id", joined(L.referenced_tables(F.col("sql"))).alias("tables"))


@query
def label_query_log_query(spark, sf):
    return labelled_log(spark, sf).select(
        "query_id", "instruction", joined("keywords").alias("keywords"), "complexity", "category",
        joined("subcategories").alias("subcategories"), "table_count",
    )


# --- encoding -----------------------------------------------------------------------------------

@query
def index_labels(spark, sf):
    log = labelled_log(spark, sf)
    codes = written(encoding.fit_label_dict(log, HEAD_CODES), "label-dict")
    for head in HEAD_CODES:
        log = encoding.index_labels(log, head, head, codes)
    return log.select("query_id", *[f"{h}_idx" for h in HEAD_CODES])


@query
def multi_hot(spark, sf):
    return labelled_log(spark, sf).select(
        "query_id", joined(encoding.multi_hot(F.col("keywords"), S.SQL_KEYWORDS), "").alias("keywords"),
        joined(encoding.multi_hot(F.col("subcategories"), S.SUBCATEGORIES), "").alias("subcategories"),
    )


@query
def decode_index(spark, sf):
    best = decoding.softmax_argmax(F.col("complexity"))["idx"]
    coded = derived.scored_queries(spark, sf).select("query_id", best.alias("idx"), "category")
    named = encoding.decode_index(coded, "complexity", "idx", S.declared_label_dict(spark), "complexity")
    category = decoding.softmax_argmax(F.col("category"))["idx"] + 1
    return named.select("query_id", "complexity", encoding.category_name(category).alias("category"))


@query
def decode_multi_hot(spark, sf):
    flags = encoding.multi_hot(F.col("keywords"), S.SQL_KEYWORDS)
    return labelled_log(spark, sf).select(
        "query_id", joined(encoding.decode_multi_hot(flags, S.SQL_KEYWORDS), "|").alias("keywords")
    )


@query
def label_shapes(spark, sf):
    return encoding.label_shapes(labelled_log(spark, sf), HEAD_CODES, S.MULTI_HEADS)


# --- sampling and splitting -------------------------------------------------------------------

@query
def sample_n(spark, sf):
    return sampling.sample_n(log_of(spark, sf), "query_id", 10_000).select("query_id", "sql")


@query
def split_train_val_test(spark, sf):
    return sampling.split_train_val_test(log_of(spark, sf), "query_id").select("query_id", "split")


@query
def split_report(spark, sf):
    report = sampling.split_report(sampling.split_train_val_test(log_of(spark, sf), "query_id"))
    return report.select("split", "rows", rounded(F.col("share")).alias("share"))


@query
def head_subset(spark, sf):
    mined = pairs.column_pairs(pairs.usable_qa_rows(parsed_qa(spark, sf)), "row_id")
    return sampling.head_subset(mined, 5000, "row_id", "header_pos").select("row_id", "header", "label")


# --- distributions --------------------------------------------------------------------------------

@query
def value_counts(spark, sf):
    return profiling.value_counts(labelled_log(spark, sf), ["complexity", "category", "table_count"])


@query
def top_keywords(spark, sf):
    return profiling.top_keywords(labelled_log(spark, sf))


@query
def pair_balance(spark, sf):
    return profiling.pair_balance(
        pairs.column_pairs(pairs.usable_qa_rows(parsed_qa(spark, sf)), "row_id")
    )


@query
def table_vocabulary(spark, sf):
    return profiling.table_vocabulary(table_log(spark, sf))


@query
def ranking_corpus_stats(spark, sf):
    return profiling.ranking_corpus_stats(table_log(spark, sf))


# --- catalogs -------------------------------------------------------------------------------------

def customer_tables(spark, sf):
    return derived.table(spark, sf, "customer").select(
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("table")
    )


@query
def catalog_docs(spark, sf):
    described = derived.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("table"),
        F.concat(F.col("n").cast("string"), F.lit(" orders")).alias("description"),
    )
    return catalog.catalog_docs(customer_tables(spark, sf), described).select("table", "doc")


@query
def catalog_docs_with_columns(spark, sf):
    columns = derived.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("table"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("column"),
    )
    return catalog.catalog_docs_with_columns(columns)


def part_docs(spark, sf):
    return derived.table(spark, sf, "part").select(F.concat(
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"),
        F.lit(" (id, size, "), F.lower("p_type"), F.lit(")"),
    ).alias("doc"))


@query
def catalog_name(spark, sf):
    return part_docs(spark, sf).select("doc", catalog.catalog_name(F.col("doc")).alias("name"))


CATALOG_PREFIXES = [f"region{i}_" for i in range(1, 6)]
CATALOG_FILLER = "sheet_%05d (row, column, value)"


@query
def expand_catalog(spark, sf):
    fillers = derived.table(spark, sf, "supplier").count()
    return catalog.expand_catalog(part_docs(spark, sf), CATALOG_PREFIXES, fillers, CATALOG_FILLER)


# --- pairs ----------------------------------------------------------------------------------------

@query
def column_pairs(spark, sf):
    return pairs.column_pairs(pairs.usable_qa_rows(parsed_qa(spark, sf)), "row_id")


@query
def table_negatives(spark, sf):
    log = table_log(spark, sf)
    mined = pairs.table_negatives(log, profiling.table_vocabulary(log), "query_id")
    return mined.select("query_id", F.explode("negatives").alias("negative"))


def part_lists(spark, sf):
    """Every customer with two or three parts as its tables, or none at all; and all parts."""
    names = derived.table(spark, sf, "part").select(F.concat(
        F.lit("catalog.part_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))
    ).alias("table"), "p_partkey")
    total = names.agg(F.count(F.lit(1))).scalar()
    spread = derived.table(spark, sf, "customer").select("c_custkey", F.explode(F.array(
        F.col("c_custkey"), F.col("c_custkey") * 7 + 3, F.col("c_custkey") * 31 + 11
    )).alias("n")).select("c_custkey", (F.col("n") % total + 1).alias("p_partkey"))
    listed = spread.join(names, "p_partkey").groupBy("c_custkey").agg(F.sort_array(F.collect_set("table")).alias("t"))
    tables = F.when(F.col("c_custkey") % 10 != 0, F.col("t"))
    return listed.select(F.col("c_custkey").alias("query_id"), tables.alias("tables")), names.select("table")


@query
def table_negatives_large(spark, sf):
    mined = pairs.table_negatives(*part_lists(spark, sf), "query_id")
    return mined.select("query_id", F.explode("negatives").alias("negative"))


@query
def ranking_triplets_large(spark, sf):
    mined = pairs.ranking_triplets(*part_lists(spark, sf), "query_id")
    return mined.select("query_id", "positive", joined("negatives").alias("negatives"))


@query
def first_positive(spark, sf):
    return table_log(spark, sf).select("query_id", pairs.first_positive(F.col("tables")).alias("positive"))


@query
def ranking_triplets(spark, sf):
    log = table_log(spark, sf)
    mined = pairs.ranking_triplets(log, profiling.table_vocabulary(log), "query_id")
    return mined.select("query_id", "instruction", "positive", joined("negatives").alias("negatives"))


# --- ranking --------------------------------------------------------------------------------------

def vectors(spark, sf):
    return derived.vector_questions(spark, sf), derived.vector_catalog(spark, sf)


def scored(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, rounded(F.col("score")).alias("score"))


@query
def cosine_scores(spark, sf):
    return scored(ranking.cosine_scores(*vectors(spark, sf)), "query_id", "table")


@query
def scaled_scores(spark, sf):
    return scored(ranking.scaled_scores(ranking.cosine_scores(*vectors(spark, sf))), "query_id", "table")


def listed_pairs(spark, sf):
    """Questions with their own table and the next one, and with one that the catalog lacks."""
    labels = F.array(F.col("label"), (F.col("label") + 1) % 10, F.lit(99))
    return derived.vector_questions(spark, sf).select("query_id", F.explode(labels).alias("l")).select(
        "query_id", F.concat(F.lit("label_"), F.col("l").cast("string")).alias("table"))


@query
def cosine_scores_listed(spark, sf):
    return scored(ranking.cosine_scores(*vectors(spark, sf), listed_pairs(spark, sf)), "query_id", "table")


@query
def scaled_scores_listed(spark, sf):
    return scored(ranking.scaled_scores(ranking.cosine_scores(*vectors(spark, sf), listed_pairs(spark, sf))), "query_id", "table")


@query
def l2_normalize_query(spark, sf):
    unit = derived.vector_questions(spark, sf).select(
        "query_id", F.posexplode(l2_normalize(F.col("vec"))).alias("pos", "x")
    )
    return unit.select("query_id", "pos", rounded(F.col("x")).alias("x"))


def top_hints(spark, sf):
    return ranking.rank_top_k(*vectors(spark, sf), top_k=5, min_score=0.05)


@query
def rank_top_k(spark, sf):
    return scored(top_hints(spark, sf), "query_id", "rank", "table")


@query
def rank_all(spark, sf):
    return scored(ranking.rank_all(*vectors(spark, sf)), "query_id", "rank", "table")


@query
def rank_all_large(spark, sf):
    """Whole rankings over a catalog of several blocks, for the questions of one search set: ids divisible by 20."""
    entries, asked = large_vectors(spark, sf)
    return scored(ranking.rank_all(asked.where("query_id % 20 = 0"), entries), "query_id", "rank", "table")


@query
def rank_columns(spark, sf):
    ranked = ranking.rank_columns(
        derived.vector_questions(spark, sf), derived.column_catalog(spark, sf), top_k=5
    )
    return scored(ranked, "query_id", "rank", "table", "column")


def benchmark_questions(spark, sf):
    return derived.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_catalog(spark, sf):
    return derived.spread(derived.table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("table"), F.col("text").alias("doc")
    )


@query
def rank_by_text(spark, sf):
    ranked = ranking.rank_by_text(benchmark_questions(spark, sf), document_catalog(spark, sf), top_k=5)
    return scored(ranked, "query_id", "rank", "table")


@query
def rank_by_text_large(spark, sf):
    """Over a catalog of several blocks."""
    entries = catalog.expand_catalog(part_docs(spark, sf), CATALOG_PREFIXES).select(
        catalog.catalog_name(F.col("doc")).alias("table"), "doc"
    )
    asked = derived.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")
    )
    return scored(ranking.rank_by_text(asked, entries, top_k=5), "query_id", "rank", "table")


def large_vectors(spark, sf):
    """Parts with a vector and their size, more than one block holds, and questions for them."""
    vectors = derived.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    total = vectors.agg(F.count(F.lit(1))).scalar()
    entries = derived.table(spark, sf, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table"),
        (F.col("p_partkey") % total).alias("vec_id"), (F.col("p_size") / 50.0).alias("x"),
    ).join(vectors, "vec_id").select("table", F.concat("v", F.array("x")).alias("vec"))
    asked = derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("label") / 10.0)).alias("vec"),
    )
    return entries, asked


@query
def rank_top_k_large(spark, sf):
    """Dense vectors over a catalog of several blocks."""
    entries, asked = large_vectors(spark, sf)
    return scored(ranking.rank_top_k(asked, entries, 5), "query_id", "rank", "table")


HASH_DIM = 16


def hashed_words(text: Column) -> Column:
    """A small encoder: words counted by md5 into 16 cells. The words of an Arrow batch are taken
    together, and each distinct one is hashed once."""
    @F.pandas_udf("array<float>")
    def encode(tokens: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        sizes = tokens.str.len().to_numpy()
        codes, words = pd.factorize(np.concatenate([*tokens, np.empty(0, object)]))
        cells = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % HASH_DIM for w in words], np.int64)
        counts = np.zeros((len(tokens), HASH_DIM))
        np.add.at(counts, (np.repeat(np.arange(len(tokens)), sizes), cells[codes]), 1.0)
        return pd.Series(list(counts))

    return encode(ranking.word_tokens(text))


@query
def embed_with(spark, sf):
    coded = ranking.embed_with(document_catalog(spark, sf), "doc", hashed_words)
    return coded.select("table", F.posexplode("vec").alias("pos", "x")).select(
        "table", "pos", F.col("x").cast("double").alias("x")
    )


# --- hints ----------------------------------------------------------------------------------------

@query
def hint_names(spark, sf):
    return hints.hint_names(top_hints(spark, sf)).select("query_id", joined("tables").alias("tables"))


@query
def hint_scores(spark, sf):
    scores = hints.hint_scores(top_hints(spark, sf)).select("query_id", F.explode("scores").alias("table", "score"))
    return scored(scores, "query_id", "table")


@query
def hints_top(spark, sf):
    return scored(hints.hints_top(top_hints(spark, sf), 2), "query_id", "rank", "table")


@query
def hints_above(spark, sf):
    return scored(hints.hints_above(top_hints(spark, sf), 0.2), "query_id", "rank", "table")


@query
def hints_boost(spark, sf):
    boosted = hints.hints_boost(ranking.rank_top_k(*vectors(spark, sf), top_k=5), 1.0)
    return boosted.select("query_id", "table", rounded(F.col("boost")).alias("boost"))


@query
def hints_filter_record(spark, sf):
    questions = derived.vector_questions(spark, sf).select(
        "query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("text")
    )
    records = hints.hints_filter_record(top_hints(spark, sf), questions)
    return records.select(
        "query_id",
        F.get_json_object("record", "$.query").alias("query"),
        F.get_json_object("record", "$.table_names[0]").alias("first_table"),
        F.size(F.from_json(F.get_json_object("record", "$.scores"), "map<string,double>")).cast("bigint").alias("n"),
    )


@query
def hints_count(spark, sf):
    return hints.hints_count(top_hints(spark, sf))


def found_rows(spark, sf):
    """Results of some search: every line item answers one vector's question, with one table."""
    questions = derived.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return derived.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % questions).alias("query_id"),
        F.concat(F.lit("label_"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 10).cast("string")).alias("table"),
        F.col("l_orderkey").alias("item"), F.col("l_quantity").alias("relevance"),
    )


@query
def apply_hints(spark, sf):
    found, best = found_rows(spark, sf), top_hints(spark, sf)
    best = written(best, "hints")
    wanted = hints.apply_filter(found, best).select("query_id", "table").distinct().withColumn("hinted", F.lit(1))
    boosted = hints.apply_boost(found, best, "relevance")
    return boosted.groupBy("query_id", "table").agg(
        F.count(F.lit(1)).alias("items"), rounded(F.sum("relevance"), 4).alias("relevance")
    ).join(wanted, ["query_id", "table"], "left").select(
        "query_id", "table", "items", "relevance", F.coalesce("hinted", F.lit(0)).alias("hinted")
    )


# --- decoding -------------------------------------------------------------------------------------

@query
def softmax_argmax(spark, sf):
    best = {h: decoding.softmax_argmax(F.col(h)) for h in S.SINGLE_HEADS}
    return derived.scored_queries(spark, sf).select(
        "query_id", *[b["idx"].alias(f"{h}_idx") for h, b in best.items()],
        *[rounded(b["confidence"]).alias(f"{h}_confidence") for h, b in best.items()],
    )


@query
def sigmoid_threshold(spark, sf):
    return derived.scored_queries(spark, sf).select(
        "query_id",
        joined(decoding.sigmoid_threshold(F.col("keywords"), S.SQL_KEYWORDS)).alias("keywords"),
        joined(decoding.sigmoid_threshold(F.col("subcategory"), S.SUBCATEGORIES)).alias("subcategories"),
    )


@query
def fallback_label(spark, sf):
    logits = F.col("subcategory")
    strict = decoding.sigmoid_threshold(logits, S.SUBCATEGORIES, threshold=0.58)
    return derived.scored_queries(spark, sf).select(
        "query_id", joined(decoding.fallback_label(strict, logits, S.SUBCATEGORIES)).alias("subcategories")
    )


def flat_record(records: DataFrame) -> DataFrame:
    names = F.transform("tables", lambda t: t["table"])
    return records.select(
        "query_id", "query", "complexity", rounded(F.col("complexity_confidence")).alias("complexity_confidence"),
        joined("keywords").alias("keywords"), "category",
        rounded(F.col("category_confidence")).alias("category_confidence"),
        joined("subcategories").alias("subcategories"), "estimated_tables",
        rounded(F.col("table_count_confidence")).alias("table_count_confidence"),
        joined(names).alias("tables"), rounded(F.get("tables", F.lit(0))["confidence"]).alias("best"),
    )


@query
def analysis_record(spark, sf):
    questions = derived.vector_questions(spark, sf).select(
        "query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("text")
    )
    heads = list(S.SINGLE_HEADS) + list(S.MULTI_HEADS)
    logits = decoding.spread_logits(derived.scored_queries(spark, sf), heads)
    decoded = decoding.decode(decoding.gather_logits(logits))
    best = ranking.scaled_scores(top_hints(spark, sf))
    return flat_record(decoding.analysis_record(decoded, questions, best))


# --- text models ----------------------------------------------------------------------------------

def document_labels(spark, sf):
    """Documents with quality and toxic flags, split."""
    docs = derived.spread(derived.table(spark, sf, "documents").select("doc_id", "text"))
    return sampling.split_train_val_test(docs.join(derived.table(spark, sf, "labels"), "doc_id"), "doc_id")


DOCUMENT_HEADS = [textmodel.Head("quality", "quality", 2), textmodel.Head("toxic", "toxic", 2)]


def document_model(spark, sf):
    return textmodel.fit_text_labels(
        document_labels(spark, sf).where("split = 'train'"), "text", DOCUMENT_HEADS
    )


@query
def tokens(spark, sf):
    return textmodel.tokens(derived.table(spark, sf, "conversations"), "conv_id", "text").groupBy(
        "conv_id", "token"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query
def token_document_frequency(spark, sf):
    df = ranking.token_document_frequency(document_catalog(spark, sf), "table", "doc")
    return df.select("token", "df", rounded(F.col("idf")).alias("idf"))


@query
def fit_text_labels(spark, sf):
    return document_model(spark, sf).words.select("token", *[
        rounded(F.get("weights", F.lit(i))).alias(n) for i, n in enumerate(["q0", "q1", "t0", "t1"])
    ])


@query
def document_frequency_upkeep(spark, sf):
    """Frequencies of a catalog of documents after a third of the entries was dropped and another third added."""
    docs = derived.table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc"))
    third = lambda i: docs.where(F.col("doc_id") % 3 == i)
    before = written(catalog_store.document_frequencies(docs.where("doc_id % 3 != 2")), "frequencies")
    after = catalog_store.changed_frequencies(before, catalog_store.document_frequencies(third(2)), catalog_store.document_frequencies(third(0), sign=-1))
    return catalog_store.inverse_frequencies(written(after, "frequencies")).select("token", "df", rounded(F.col("idf")).alias("idf"))


@query
def predict_text_labels(spark, sf):
    logits = textmodel.predict_text_labels(
        document_model(spark, sf), derived.table(spark, sf, "documents"), "doc_id", "text"
    )
    best = {h.name: decoding.softmax_argmax(F.col(h.name))["idx"] for h in DOCUMENT_HEADS}
    return logits.select(
        "doc_id", *[b.alias(f"{h}_pred") for h, b in best.items()],
        *[rounded(F.get(h.name, F.lit(i)), 4).alias(f"{h.name}_{i}") for h in DOCUMENT_HEADS for i in range(2)],
    )


@query
def fit_text_labels_lr(spark, sf):
    """Logits of all documents by the model that the training documents gave."""
    data = written(document_labels(spark, sf), "labelled-documents")
    fitted = linear.fit_text_labels_lr(data.where("split = 'train'"), "doc_id", "text", DOCUMENT_HEADS)
    logits = linear.predict_text_labels_lr(fitted, data, "doc_id", "text")
    return logits.select(
        "doc_id", *[decoding.softmax_argmax(F.col(h.name))["idx"].alias(h.name) for h in DOCUMENT_HEADS],
        *[rounded(F.get(h.name, F.lit(i)), 4).alias(f"{h.name}_{i}") for h in DOCUMENT_HEADS for i in range(2)],
    )


@query
def fit_text_tags_lr(spark, sf):
    """Weights of the tags of both multi-label heads, fitted together on the training questions."""
    data = training.training_set(log_of(spark, sf)).where("split = 'train'")
    fitted = linear.fit_text_labels_lr(data, "query_id", "instruction", [h for h in training.analyzer_heads() if h.multi])
    tags = [(h.name, tag) for h in fitted.heads for tag in S.MULTI_HEADS[h.name]]
    bias = spark.createDataFrame([("", list(fitted.bias))], "token string, weights array<double>")
    names = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(t).alias("tag")) for h, t in tags])
    return fitted.words.select("token", "weights").unionByName(bias).select(
        "token", F.inline(F.arrays_zip(names.alias("name"), F.col("weights").alias("weight")))
    ).select("name.head", "name.tag", "token", rounded(F.col("weight"), 4).alias("weight"))


@query
def pair_features(spark, sf):
    mined = pairs.column_pairs(pairs.usable_qa_rows(parsed_qa(spark, sf)), "row_id")
    features = textmodel.pair_features(mined, "row_id", "question", "header")
    return features.select("row_id", "header", "shared", *[rounded(F.col(c)).alias(c) for c in ("jaccard", "idf_share")])


@query
def fit_pair_relevance(spark, sf):
    mined = pairs.column_pairs(pairs.usable_qa_rows(parsed_qa(spark, sf)), "row_id")
    features = written(textmodel.pair_features(mined, "row_id", "question", "header"), "pair-features")
    model = linear.fit_pair_relevance(features)
    return linear.score_pair_relevance(model, features).select(
        "row_id", "header", "label", rounded(F.col("score"), 4).alias("score")
    )


# --- evaluation -----------------------------------------------------------------------------------

def predictions(spark, sf):
    """Predicted and true classes and tags of the scored queries."""
    rows = derived.scored_queries(spark, sf)
    return rows.select(
        "query_id",
        *[decoding.softmax_argmax(F.col(h))["idx"].alias(f"{h}_pred") for h in S.SINGLE_HEADS],
        *[decoding.sigmoid_threshold(F.col(h), c).alias(f"{h}_pred") for h, c in S.MULTI_HEADS.items()],
        *[f"{h}_true" for h in [*S.SINGLE_HEADS, *S.MULTI_HEADS]],
    )


def columns_of(heads) -> dict[str, tuple[str, str]]:
    return {h: (f"{h}_pred", f"{h}_true") for h in heads}


def valued(df: DataFrame) -> DataFrame:
    return df.select("head", "metric", rounded(F.col("value")).alias("value"))


@query
def accuracy(spark, sf):
    return valued(evaluation.accuracy(predictions(spark, sf), columns_of(S.SINGLE_HEADS)))


@query
def sample_f1(spark, sf):
    return valued(evaluation.sample_f1(predictions(spark, sf), columns_of(S.MULTI_HEADS)))


@query
def combined_score(spark, sf):
    data = written(training.training_set(log_of(spark, sf)), "training-set")
    return valued(training.evaluate_analyzer(training.fit_analyzer(data), data))


@query
def weighted_prf(spark, sf):
    row = evaluation.weighted_prf(predictions(spark, sf), "category_pred", "category_true")
    return row.select(*[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query
def exact_match(spark, sf):
    return valued(evaluation.exact_match(predictions(spark, sf), columns_of(["complexity", "category"])))


@query
def mean_accuracy(spark, sf):
    return valued(evaluation.mean_accuracy(predictions(spark, sf), columns_of(["complexity", "category"])))


@query
def classification_report(spark, sf):
    report = evaluation.classification_report(predictions(spark, sf), "category_pred", "category_true")
    return report.select("kind", "class", "support", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query
def multi_output_log_loss(spark, sf):
    rows = derived.scored_queries(spark, sf).withColumns({
        f"{h}_bits": encoding.multi_hot(F.col(f"{h}_true"), c) for h, c in S.MULTI_HEADS.items()
    })
    return valued(evaluation.multi_output_log_loss(
        rows, {h: (h, f"{h}_true") for h in S.SINGLE_HEADS}, {h: (h, f"{h}_bits") for h in S.MULTI_HEADS}
    ))


def label_triplets(spark, sf):
    """Every vector with the table of its label and five hash-chosen other tables."""
    questions = derived.vector_questions(spark, sf).withColumn(
        "tables", F.array(F.concat(F.lit("label_"), F.col("label").cast("string")))
    )
    vocabulary = questions.select(F.explode("tables").alias("table")).distinct()
    return pairs.ranking_triplets(questions, vocabulary, "query_id")


def scored_label_pairs(spark, sf):
    """Cosine and 1/0 relevance of every vector with its own and with the five other tables."""
    triplets = label_triplets(spark, sf)
    met = triplets.select(
        "query_id", "vec", "positive", F.explode(F.concat(F.array("positive"), "negatives")).alias("table")
    ).join(derived.vector_catalog(spark, sf).withColumnRenamed("vec", "table_vec"), "table")
    return met.select(
        "query_id", "table", F.round(cosine(F.col("vec"), F.col("table_vec")), 9).alias("score"),
        (F.col("table") == F.col("positive")).cast("double").alias("label"),
    )


@query
def info_nce(spark, sf):
    return valued(evaluation.info_nce(label_triplets(spark, sf), derived.vector_catalog(spark, sf), 0.1))


@query
def cosine_mse(spark, sf):
    return valued(evaluation.cosine_mse(scored_label_pairs(spark, sf)))


@query
def score_correlation(spark, sf):
    return valued(evaluation.score_correlation(scored_label_pairs(spark, sf)))


@query
def hits_at_k(spark, sf):
    expected = derived.vector_questions(spark, sf).select("query_id", F.array(
        F.concat(F.lit("label_"), F.col("label").cast("string")),
        F.concat(F.lit("label_"), ((F.col("label") + 1) % 10).cast("string")),
    ).alias("expected"))
    return evaluation.hits_at_k(ranking.rank_top_k(*vectors(spark, sf), top_k=10), expected, 3)


@query
def recall_at_k(spark, sf):
    expected = derived.vector_questions(spark, sf).select("query_id", F.explode(F.array(
        F.concat(F.lit("label_"), F.col("label").cast("string")),
        F.concat(F.lit("label_"), ((F.col("label") + 1) % 10).cast("string")),
    )).alias("table"))
    recall = evaluation.recall_at_k(ranking.rank_top_k(*vectors(spark, sf), 5, -1.0), expected, [1, 3, 5])
    return recall.select("k", rounded(F.col("recall")).alias("recall"))


# --- serving --------------------------------------------------------------------------------------

def analyzer(spark, sf):
    return training.fit_analyzer(training.training_set(log_of(spark, sf)))


def log_questions(spark, sf):
    return log_of(spark, sf).select("query_id", F.col("instruction").alias("text"))


def log_catalog(spark, sf):
    """The tables of the log as a catalog, written out because a ranking reads it several times."""
    names = written(profiling.table_vocabulary(table_log(spark, sf)), "log-catalog")
    return names.withColumn("doc", F.col("table"))


@query
def analyze_batch(spark, sf):
    return flat_record(serving.analyze_batch(
        log_questions(spark, sf), analyzer(spark, sf), log_catalog(spark, sf)
    ))


ONE_QUESTION = "Which suppliers deliver late and how many line items are returned"


@query
def analyze(spark, sf):
    return flat_record(serving.analyze(spark, ONE_QUESTION, analyzer(spark, sf), log_catalog(spark, sf)))


def list_requests(spark, sf):
    """Every order's question with a list of tables, long or short, or none."""
    order = F.col("query_id")
    listed = (
        F.when(order % 5 == 0, F.lit("customers (id, name)|orders (id, customer)|logs|staff (name, pay)"))
        .when(order % 5 == 1, F.lit("customers, orders, products, sales ,, sessions"))
        .when(order % 5 == 2, F.lit("  "))
        .when(order % 5 == 3, F.lit("inventory stock,audit entry,user preferences"))
    )
    return log_of(spark, sf).select("query_id", F.col("instruction").alias("query"), listed.alias("tables"))


@query
def rank_request(spark, sf):
    return scored(serving.rank_requests(list_requests(spark, sf), 3), "query_id", "rank", "table")


@query
def label_info(spark, sf):
    fitted = encoding.fit_label_dict(labelled_log(spark, sf), HEAD_CODES)
    return serving.label_info(fitted).select("head", joined("labels", "|").alias("labels"))


@query
def combined_analysis(spark, sf):
    both = serving.combined_analysis(list_requests(spark, sf), analyzer(spark, sf), 3)
    return both.select(
        "query_id", "complexity", "category", "estimated_tables", joined("keywords").alias("keywords"),
        joined("tables", "|").alias("tables"),
    )


@query
def route_queries(spark, sf):
    questions = log_questions(spark, sf)
    counts = written(ranking.term_counts(questions, "query_id", "text"), "question-terms")
    records = serving.analyze_batch(questions, analyzer(spark, sf), counts=counts)
    ranked = ranking.rank_by_text(questions, log_catalog(spark, sf), top_k=S.HINTS_TOP_K, counts=counts)
    return serving.route_queries(records, ranked).select(
        "query_id", "complexity", "route", joined("tables").alias("tables")
    )


@query
def analyze_stream_query(spark, sf):
    arrivals = (
        spark.readStream.schema("conv_id bigint, turn bigint, role string, text string")
        .parquet(f"{sf}/conversations*.parquet")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    )
    items = derived.table(spark, sf, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("table"), F.col("text").alias("doc")
    )
    folder = shared_folder(spark, "stream")
    running = analyze_stream(
        arrivals, analyzer(spark, sf), items, f"{folder}/records", f"{folder}/progress",
        top_k=5, available_now=True,
    )
    running.awaitTermination()
    return flat_record(spark.read.parquet(f"{folder}/records")).drop("query")
