import pytest
from pyspark.sql import functions as F

from hintwise import schemas as S
from hintwise.functions.text import extract_prompt, extract_prompt_strict, strip
from hintwise.operators.catalog import catalog_name
from hintwise.operators.encoding import decode_multi_hot, fit_label_dict, multi_hot
from hintwise.sources import readers, writers


def one(df):
    return [tuple(r) for r in df.collect()]


def test_prompts(spark):
    df = spark.createDataFrame([
        (0, "a prompt: q1 prompt: q2 schema: s"), (1, "no marker schema: s"), (2, None), (3, " plain "),
        (4, "prompt:\n\tq\r\n"), (5, "schema: s prompt: q"),
    ], "id int, t string")
    loose = one(df.select(extract_prompt(F.col("t"))).orderBy("id"))
    strict = one(df.select(extract_prompt_strict(F.col("t"))).orderBy("id"))
    assert [r[0] for r in loose] == ["q1", "no marker", "", "plain", "q", "q"]
    assert [r[0] for r in strict] == ["q1", "", "", "", "q", "q"]
    assert one(spark.sql("SELECT ' \t\nx　' AS v").select(strip(F.col("v")))) == [("x",)]


def test_csv_round_trip(spark, tmp_path):
    rows = [
        (1, 'a "quoted" prompt: x, y', "SELECT 1,\n2"), (2, " padded ", "NULL"), (3, None, "nan"),
        (4, "null", ""), (5, "back\\slash", "NAN"),
    ]
    path = str(tmp_path / "log")
    writers.write_csv(spark.createDataFrame(rows, S.QUERY_LOG), path)
    got = one(readers.read_csv(spark, path, S.QUERY_LOG).orderBy("query_id"))
    assert got == [
        (1, 'a "quoted" prompt: x, y', "SELECT 1,\n2"), (2, " padded ", None), (3, None, None),
        (4, None, None), (5, "back\\slash", "NAN"),
    ]


def test_plain_layout(spark, tmp_path):
    path = str(tmp_path / "plain")
    writers.write_csv(spark.createDataFrame([(1, "ask", "SELECT 1"), (2, None, "SELECT 2")], S.QUERY_LOG_PLAIN), path)
    log = readers.read_query_log(spark, path, S.QUERY_LOG_PLAIN)
    assert one(log.select("query_id", "instruction", "sql").orderBy("query_id")) == [
        (1, "ask", "SELECT 1"), (2, None, "SELECT 2")]
    corpus = readers.read_ranking_corpus(spark, path, S.QUERY_LOG_PLAIN)
    assert one(corpus.select("instruction", "sql")) == [("ask", "SELECT 1")]


def write_file(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    structured = write_file(tmp_path / "a.csv", ["query_id,sql,extra,structured_input", "7,SELECT 1 FROM t,z,x prompt: hello schema: s"])
    log = readers.read_query_log(spark, structured, S.QUERY_LOG)
    assert one(log.select("query_id", "instruction", "sql")) == [(7, "hello", "SELECT 1 FROM t")]
    plain = write_file(tmp_path / "b.csv", ["query,instruction", "SELECT 2,ask", "SELECT 2,ask", "SELECT 3,"])
    log = readers.read_query_log(spark, plain)
    assert sorted(one(log.select("sql", "instruction")), key=str) == [("SELECT 2", "ask"), ("SELECT 2", "ask"), ("SELECT 3", None)]
    keys = [r.query_id for r in log.collect()]
    assert len(set(keys)) == 3 and sorted(keys) == sorted(r.query_id for r in readers.read_query_log(spark, plain, multi_line=False).collect())
    with pytest.raises(ValueError, match="structured_input"):
        readers.read_query_log(spark, plain, S.QUERY_LOG)
    with pytest.raises(ValueError, match="query"):
        readers.read_query_log(spark, write_file(tmp_path / "c.csv", ["instruction,other", "a,b"]))
    write_file(tmp_path / "train.csv", ["sql,question,table", "s,q,t"])
    assert one(readers.read_qa_corpus(spark, str(tmp_path), "train").select("question", "table", "sql", "split")) == [("q", "t", "s", "train")]


def test_row_keys_number_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 1), ("a", 1)], "x string, y int")
    keyed = readers.with_row_key(df, "k")
    assert sorted(one(keyed.select("x", "y")), key=str) == sorted(one(df), key=str)
    keys = {r.k for r in keyed.collect()}
    assert len(keys) == 5 and keys == {r.k for r in readers.with_row_key(df.repartition(3), "k").collect()}


def test_qa_split_names(spark, tmp_path):
    for name in ("train", "validation", "test"):
        writers.write_csv(spark.createDataFrame([("r", name, "t", "s")], S.QA_CORPUS), str(tmp_path / f"{name}.csv"))
    read = {s: one(readers.read_qa_corpus(spark, str(tmp_path), s).select("question", "split")) for s in ("train", "val", "other")}
    assert read == {"train": [("train", "train")], "val": [("validation", "val")], "other": [("test", "test")]}


def test_catalog_lists(spark):
    df = spark.createDataFrame([(1, "a (x, y)| b |"), (2, "a, b,, c"), (3, " , "), (4, None)], "id int, t string")
    assert one(readers.parse_catalog_list(df, "t").select("id", "entry_pos", "table").orderBy("id", "entry_pos")) == [
        (1, 0, "a (x, y)"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")]
    docs = ["customers (id, name)", "plain", "\t users (id)", "\n\xa0wide\u3000(id)", "  "]
    names = spark.createDataFrame([(d,) for d in docs], "doc string").select(catalog_name(F.col("doc")))
    assert one(names) == [("customers",), ("plain",), ("users",), ("wide",), ("",)]


def test_requests(spark):
    df = spark.createDataFrame([("q", ["t"]), (" \t", ["t"]), (None, None), ("q", [])], "query string, tables array<string>")
    valid, rejected = readers.split_requests(df, need_tables=True)
    assert one(valid.select("query")) == [("q",)]
    assert sorted(r.reason for r in rejected.collect()) == [
        "blank_query", "blank_query", "no_tables"]
    with pytest.raises(ValueError):
        readers.split_requests(df.where("false"))


def test_label_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("medium",), ("simple",), ("medium",), (None,)], "c string")
    path = str(tmp_path / "dict")
    writers.write_label_dict(fit_label_dict(df, {"complexity": "c"}), path)
    assert one(readers.read_label_dict(spark, path).orderBy("idx")) == [
        ("complexity", 0, "medium"), ("complexity", 1, "simple")]
    tags = spark.createDataFrame([(["b", "zzz"],), ([],)], "t array<string>")
    bits = multi_hot(F.col("t"), ["a", "b"])
    assert one(tags.select(bits, decode_multi_hot(bits, ["a", "b"]))) == [([0, 1], ["b"]), ([0, 0], [])]


def test_declared_counts(spark):
    assert len(S.SQL_KEYWORDS) == 46 and len(S.SUBCATEGORIES) == 16
    assert S.declared_label_dict(spark).count() == 74
