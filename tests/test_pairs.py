from pyspark.sql import functions as F

from hintwise.operators import pairs
from hintwise.operators.profiling import table_vocabulary
from hintwise.plans import registry


def parse(spark, table, sql):
    df = spark.createDataFrame([("r", " question ", table, sql)], "row_id string, question string, table string, sql string")
    return pairs.with_qa_columns(pairs.filter_questions(df)).first()


def test_headers_and_columns(spark):
    table = "{'header': array(['first name', 'x', ':bad', 'total',\n 'date', '" + "y" * 50 + "'], dtype=object)}"
    row = parse(spark, table, "{'sel': 1, 'column_index': array([0, 2, 9, -1])}")
    assert row.headers == ["first name", "total", "date"]
    assert (row.sel, row.conds, row.relevant) == (1, [0, 2, 9, -1], [0, 1, 2])
    assert parse(spark, table, "{'sel': 7, 'column_index': array([1., 2])}").relevant == []
    assert parse(spark, table, "{'column_index': array([])}").sel is None
    assert parse(spark, None, None).headers == []


def test_column_pairs_balance(spark, sf):
    usable = pairs.usable_qa_rows(registry.parsed_qa(spark, sf))
    per_row = pairs.column_pairs(usable, "row_id").groupBy("row_id").agg(
        F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
        F.countDistinct("header_pos").alias("distinct"), F.count("*").alias("n"),
    ).join(usable.select("row_id", F.size("relevant").alias("rel"), F.size("headers").alias("all")), "row_id")
    assert per_row.where(
        (F.col("pos") != F.col("rel")) | (F.col("neg") != F.least(F.col("all") - F.col("rel"), 2 * F.col("rel")))
        | (F.col("distinct") != F.col("n"))
    ).isEmpty()


def test_negatives_both_ways(spark, sf):
    log = registry.table_log(spark, sf)
    vocabulary = table_vocabulary(log)
    inside = pairs.table_negatives(log, vocabulary, "query_id")
    joined = pairs.table_negatives(log, vocabulary, "query_id", limit=-1)
    left = {r.query_id: r.negatives for r in inside.collect()}
    assert left == {r.query_id: r.negatives for r in joined.collect()}
    tables = {r.query_id: set(r.tables) for r in log.collect()}
    for q, negatives in left.items():
        assert len(negatives) == len(set(negatives)) == 5 and not tables[q] & set(negatives)


def test_small_vocabularies(spark):
    log = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c"]), (3, []), (4, ["zzz", "b"])], "query_id bigint, tables array<string>")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",)], "table string")
    odd = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (2, None), (None, ["c"]), (None, ["c"])], "query_id bigint, tables array<string>")
    for limit in (None, -1):
        rows = sorted(((r.query_id or 0, r.tables or [], sorted(r.negatives)) for r in pairs.table_negatives(odd, vocabulary, "query_id", limit=limit).collect()), key=str)
        assert rows == [(0, ["c"], ["a", "b"]), (0, ["c"], ["a", "b"]), (1, ["a"], ["b", "c"]), (1, ["b"], ["a", "c"]), (2, [], [])]
        got = pairs.ranking_triplets(log, vocabulary, "query_id", limit=limit).orderBy("query_id").collect()
        assert [sorted(r.negatives) for r in got] == [["b", "c"], [], ["a", "b", "c"], ["a", "c"]]
        assert [r.positive for r in got] == ["a", "a", None, "b"]


def test_negatives_are_uniform(spark):
    names = [f"t{i:02d}" for i in range(12)]
    log = spark.range(6000).select(F.col("id").alias("query_id"), F.array(F.lit("t03")).alias("tables"))
    vocabulary = spark.createDataFrame([(n,) for n in names], "table string")
    mined = pairs.table_negatives(log, vocabulary, "query_id").select(F.explode("negatives").alias("t"))
    counts = {r.t: r["count"] for r in mined.groupBy("t").count().collect()}
    assert set(counts) == set(names) - {"t03"}
    expected = 6000 * 5 / 11
    assert all(abs(n - expected) < 0.06 * expected for n in counts.values())
