"""Inputs derived from the star-schema and text tables: a query log, a question/table/SQL
corpus, vector catalogs, model scores with truth, and text catalogs. Each has one row per row
of the table it comes from, so the work grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise.functions.text import array_lit
from hintwise.schemas import SUBCATEGORIES, SQL_KEYWORDS

# question and statement of each kind of log entry; {k} is the customer key
TEMPLATES = [
    ("Find customer number {k}", "SELECT * FROM customers WHERE id = {k}"),
    ("Count orders for each name and show the ten largest",
     "SELECT name, COUNT(*) AS n FROM orders GROUP BY name ORDER BY n DESC LIMIT 10"),
    ("Which customers placed an order above {k}",
     "SELECT c.name FROM customers c JOIN orders o ON c.id = o.customer_id WHERE o.total > {k}"),
    ("List customers with their orders and items that have a stock number",
     "SELECT c.name FROM customers c LEFT JOIN orders o ON c.id = o.cid "
     "INNER JOIN items i USING (oid) WHERE i.sku IS NOT NULL"),
    ("Find staff paid more than the average", "SELECT name FROM staff WHERE pay > (SELECT AVG(pay) FROM staff)"),
    ("Combine the ids of both lists", "SELECT id FROM a UNION SELECT id FROM b"),
    ("Record audit entry {k}", "INSERT INTO audit_logs (id) VALUES ({k})"),
    ("Set the stock of other goods to {k}", "UPDATE inventory SET qty = {k} WHERE sku NOT IN (1, 2)"),
    ("Remove sessions that expired before {k}", "DELETE FROM sessions WHERE expires_at < {k}"),
    ("Create a table for user preferences", "CREATE TABLE prefs (id INT)"),
    ("Let analysts read the reports", "GRANT SELECT ON reports TO analysts"),
    ("Undo the current changes", "ROLLBACK"),
    ("Number the sales within each region",
     "SELECT r, ROW_NUMBER() OVER (PARTITION BY r ORDER BY s) AS rn FROM sales"),
    ("Which departments pay more than {k} in total",
     "SELECT dept, SUM(pay) AS s FROM staff GROUP BY dept HAVING SUM(pay) > {k}"),
    ("Flag notes about exceptions with values up to {k}",
     "SELECT DISTINCT CASE WHEN x BETWEEN 1 AND {k} THEN 1 ELSE 0 END AS b FROM t WHERE note LIKE 'EXCEPTION%'"),
    ("A question without a statement", None),
    ("Suppliers whose parts are out of stock or below {k}",
     "SELECT s.name FROM depot.suppliers s RIGHT JOIN depot.parts p ON s.id = p.sid "
     "WHERE p.stock IS NULL OR p.stock < {k} LIMIT 5 OFFSET 10"),
    ("Largest and smallest payment for each day of the month",
     "SELECT EXTRACT(DAY FROM paid_at) AS d, MAX(amount), MIN(amount) FROM ledger GROUP BY EXTRACT(DAY FROM paid_at)"),
    ("Customers with a complaint but no refund",
     "SELECT id FROM customers c WHERE EXISTS (SELECT 1 FROM complaints x WHERE x.cid = c.id)\n"
     "  AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.cid = c.id)"),
    ("Ids in both lists but not in the third", "SELECT id FROM a INTERSECT SELECT id FROM b EXCEPT SELECT id FROM c"),
    ("Add a grade to the staff table", "ALTER TABLE staff ADD COLUMN grade INT"),
    ("Get rid of the old table number {k}", "\n DROP TABLE old_{k}"),
    ("Empty the audit log", "TRUNCATE TABLE audit_logs"),
    ("Move {k} between the accounts", "BEGIN; UPDATE accounts SET v = v - {k} WHERE id = 1; COMMIT"),
    ("Keep the changes", "COMMIT"),
    ("Take the reports away from interns", "REVOKE SELECT ON reports FROM interns"),
    ("Running total of sales by day", "SELECT d, SUM(v) OVER(ORDER BY d) FROM sales"),
    ("Customers with more than {k} orders",
     "SELECT t.n\nFROM (\n  SELECT c.name AS n, COUNT(*) AS k\n  FROM shop.customers c\n"
     "  JOIN shop.orders o ON o.cid = c.id\n  GROUP BY c.name\n) t\nWHERE t.k > {k}"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than the cluster has cores out to all cores, before costly
    per-row work. A large table has many more splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _by_template(number: Column, texts: list[str | None], key: Column) -> Column:
    return F.replace(F.get(array_lit(texts), number), F.lit("{k}"), key)


def raw_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, structured_input, sql)``, one entry per order. Some prompts are null, lack
    the marker or hold it twice; a third of the statements is lower case."""
    key = F.col("o_custkey").cast("string")
    kind = (F.col("o_orderkey") % len(TEMPLATES)).cast("int")
    order = F.col("o_orderkey")
    question = _by_template(kind, [q for q, _ in TEMPLATES], key)
    statement = _by_template(kind, [s for _, s in TEMPLATES], key)
    prompt = (
        F.when(order % 11 == 3, None)
        .when(order % 7 == 0, F.concat(F.lit(" "), question, F.lit("\t")))
        .when(order % 13 == 5, F.concat(F.lit("x prompt: "), question, F.lit(" prompt: again schema: s")))
        .otherwise(F.concat(F.lit("x prompt: \n"), question, F.lit("  schema: t (a, b)")))
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("query_id"),
        prompt.alias("structured_input"),
        F.when(order % 3 == 0, F.lower(statement)).otherwise(statement).alias("sql"),
    )


def raw_qa_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, question, table, sql)`` with printed arrays, one row per line item. Some rows
    have an empty or broken index list, a selected column out of range, a short question or a
    table without header."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    header = (
        "{'header': array(['order key', 'part key', 'quantity', 'price', 'flag', 'x'], dtype=object), "
        "'id': 't'}"
    )
    indexes = (
        F.when(part % 10 == 3, F.lit(""))
        .when(part % 10 == 7, F.lit("1., 2"))
        .otherwise(F.concat_ws(", ", (part % 5).cast("string"), (supp % 5).cast("string")))
    )
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    ))
    return lines.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.unix_date(F.col("l_shipdate").cast("date")),
        ).alias("row_id"),
        F.when(part % 50 == 1, F.lit(" ab  "))
        .otherwise(F.concat(F.lit(" which part key has quantity "), F.col("l_quantity").cast("int"), F.lit(" ")))
        .alias("question"),
        F.when(part % 50 == 2, F.lit("{'name': 'none'}")).otherwise(F.lit(header)).alias("table"),
        F.concat(
            F.lit("{'sel': "), (line % 7).cast("string"),
            F.lit(", 'conds': {'column_index': array(["), indexes, F.lit("])}}"),
        ).alias("sql"),
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, vec, label)``: every vector is a question."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label"
    )


def mean_vector(vec: str, dim: int) -> Column:
    return F.array(*[F.avg(F.get(vec, F.lit(i))) for i in range(dim)])


def vector_catalog(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """``(table, vec)``: one table per label, encoded as the mean of the label's vectors."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        mean_vector("embedding", dim).alias("vec")
    ).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"), "vec")


def column_catalog(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """``(table, column, vec)``: four columns per label, both names with a dot."""
    return table(spark, sf_dir, "embeddings").groupBy(
        "label", (F.col("vec_id") % 4).alias("c")
    ).agg(mean_vector("embedding", dim).alias("vec")).select(
        F.concat(F.lit("mart.label_"), F.col("label").cast("string")).alias("table"),
        F.concat(F.lit("c."), F.col("c").cast("string")).alias("column"), "vec",
    )


def scored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores for the five heads with the truth, one row per vector: slices of the vector
    serve as logits."""
    vec = F.col("embedding").cast("array<double>")
    label = F.col("label")

    def tags(classes: list[str]) -> Column:
        numbered = array_lit(classes)
        return F.filter(numbered, lambda c, i: (label + i) % 5 == 0)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.slice(vec, 1, 3).alias("complexity"),
        F.slice(vec, 4, 6).alias("category"),
        F.slice(vec, 10, 3).alias("table_count"),
        F.slice(vec, 1, len(SQL_KEYWORDS)).alias("keywords"),
        F.slice(vec, 47, len(SUBCATEGORIES)).alias("subcategory"),
        (label % 3).alias("complexity_true"),
        (label % 6).alias("category_true"),
        ((label + 1) % 3).alias("table_count_true"),
        tags(SQL_KEYWORDS).alias("keywords_true"),
        tags(SUBCATEGORIES).alias("subcategory_true"),
    )
