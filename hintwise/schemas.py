"""Column layouts and label dictionaries shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: label classes in their declared order -------------------------------
COMPLEXITY_LABELS = ["simple", "medium", "complex"]

SQL_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE",
    "FROM", "WHERE", "JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN",
    "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "OFFSET",
    "DISTINCT", "COUNT", "SUM", "AVG", "MAX", "MIN",
    "AND", "OR", "IN", "NOT IN", "EXISTS", "NOT EXISTS",
    "BETWEEN", "LIKE", "IS NULL", "IS NOT NULL",
    "UNION", "INTERSECT", "EXCEPT",
    "SUBQUERY", "CASE", "WHEN", "THEN", "ELSE",
    "CREATE", "ALTER", "DROP", "TRUNCATE",
    "AS", "ON", "USING",
]

CATEGORIES = [
    "Data Manipulation",
    "Schema Definition",
    "Set Operations",
    "Transaction Control",
    "Security",
    "Procedural SQL",
]

SUBCATEGORIES = [
    "Read", "Write", "Aggregation", "Filtering", "Sorting",
    "Joining", "Grouping", "Limiting", "Subquery",
    "Windowing", "Set Logic", "Object DDL", "Constraints",
    "Indexing", "Transactions", "Permissions",
]

TABLE_COUNT_LABELS = ["1", "2", "3+"]

# words that can follow FROM / JOIN / INTO / UPDATE without being a table name
NOT_TABLE_NAMES = [
    "select", "from", "where", "join", "on", "and", "or", "group", "order", "by", "limit",
]

# words that decide complexity, category and subcategories
AGGREGATES = ["COUNT", "SUM", "AVG", "MAX", "MIN"]
JOINS = ["JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN"]
SET_OPERATORS = ["UNION", "INTERSECT", "EXCEPT"]
DEFINING_WORDS = ["CREATE", "ALTER", "DROP", "TRUNCATE"]
RIGHTS_WORDS = ["GRANT", "REVOKE"]
TRANSACTION_WORDS = ["BEGIN", "COMMIT", "ROLLBACK"]
WINDOW_SIGNS = ["OVER(", "OVER ("]

# printed form of the question/table corpus: header names, selected column, condition columns
HEADER_BLOCK = r"(?s)header':\s*array\(\[(.*?)\], dtype"
# a quoted name; the group holds those of 2 to 49 characters that do not start with a colon
HEADER_NAME = r"'(?:([^':][^']{1,48})'|[^']+')"
SELECTED_COLUMN = r"'sel':\s*(\d+)"
CONDITION_COLUMNS = r"'column_index':\s*array\(\[([^\]]*)\]"

# cells that a pandas CSV reader turns into nulls (public pandas documentation)
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SEED = 42
SPLIT_SHARES = {"train": 0.70, "val": 0.10, "test": 0.20}
NUM_NEGATIVES = 5
HINTS_TOP_K = 20
LABEL_THRESHOLD = 0.5
LOSS_WEIGHTS = {
    "complexity": 1.0, "keywords": 1.0, "category": 1.0, "subcategory": 1.0, "table_count": 0.5,
}
# --- end of fixed values ---------------------------------------------------------------

SINGLE_HEADS = {
    "complexity": COMPLEXITY_LABELS,
    "category": CATEGORIES,
    "table_count": TABLE_COUNT_LABELS,
}
MULTI_HEADS = {"keywords": SQL_KEYWORDS, "subcategory": SUBCATEGORIES}

# column of the labelled log that holds each head's truth
HEAD_COLUMNS = {
    "complexity": "complexity",
    "keywords": "keywords",
    "category": "category",
    "subcategory": "subcategories",
    "table_count": "table_count",
}

QUERY_LOG = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("structured_input", T.StringType()),
    T.StructField("sql", T.StringType()),
])

QUERY_LOG_PLAIN = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("query", T.StringType()),
])

QA_CORPUS = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("sql", T.StringType()),
])

LABEL_DICT = T.StructType([
    T.StructField("head", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("label", T.StringType()),
])


def declared_label_dict(spark: SparkSession) -> DataFrame:
    """The declared classes of all heads as ``label_dict(head, idx, label)``: 74 rows."""
    rows = [
        (head, idx, label)
        for head, labels in {**SINGLE_HEADS, **MULTI_HEADS}.items()
        for idx, label in enumerate(labels)
    ]
    return spark.createDataFrame(rows, LABEL_DICT)
