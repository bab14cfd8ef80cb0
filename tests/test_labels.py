import rules
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hintwise.functions import sql_labels as L
from hintwise.operators.labelling import label_query_log, with_referenced_tables
from hintwise.plans import registry
from hintwise.schemas import SQL_KEYWORDS


def labelled(spark, statements):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statements)], "id bigint, sql string")
    return {r.id: r for r in with_referenced_tables(label_query_log(df)).collect()}


def test_traps(spark):
    rows = labelled(spark, [
        "select a from b where x not in (1)",
        "SELECT a FROM t GROUP  BY a ORDER\nBY a",
        "SELECT SELECTED FROM (x)",
        "CREATED by someone",
        "SELECT reunion FROM exceptional",
        "delete from update x",
        "SELECT EXTRACT(YEAR FROM d) FROM s.orders JOIN \"q\" ON 1",
        "  \n\tselect 1",
        "WITH w AS (SELECT 1) SELECT * FROM w",
        "SELECT sum(x) OVER(PARTITION BY y) FROM t",
        None,
        "",
        "select * from a join b join c join d",
        "SELECT a_select, JOINED FROM t",
    ])
    assert {"IN", "NOT IN"} <= set(rows[0].keywords)
    assert not {"GROUP BY", "ORDER BY"} & set(rows[1].keywords)
    assert "SUBQUERY" in rows[2].keywords
    assert rows[3].category == "Schema Definition"
    assert rows[4].category == "Set Operations"
    assert rows[5].tables == ["update", "x"]
    assert rows[6].tables == ["d", "s"]
    assert rows[7].subcategories == ["Read"] and rows[7].category == "Data Manipulation"
    assert "Read" not in rows[8].subcategories and "Subquery" in rows[8].subcategories
    assert "Windowing" in rows[9].subcategories
    assert (rows[10].keywords, rows[10].complexity, rows[10].table_count, rows[10].subcategories) == (
        [], "simple", "1", ["Read"])
    assert rows[11].category == "Data Manipulation" and rows[11].tables == []
    assert rows[12].table_count == "3+"
    assert "JOIN" not in rows[13].keywords and "SELECT" in rows[13].keywords


words = st.sampled_from(
    SQL_KEYWORDS + [k.lower() for k in SQL_KEYWORDS]
    + ["(", ")", ",", "t1", "x_y", "SELECTED", "rejoin", "OVER(", "OVER (", "PARTITION BY", "1", ";", "'"]
)


@settings(max_examples=3, deadline=None)
@given(statements=st.lists(st.lists(words, max_size=25), min_size=120, max_size=160), glue=st.sampled_from([" ", "  ", "\n", ""]))
def test_against_rules(spark, statements, glue):
    texts = [glue.join(s) if i % 2 else " ".join(s) for i, s in enumerate(statements)]
    for i, row in labelled(spark, texts).items():
        kws = rules.keywords(texts[i])
        assert row.keywords == kws
        assert row.complexity == rules.complexity(texts[i], kws)
        assert row.table_count == rules.table_count(texts[i])
        assert row.tables == rules.tables(texts[i])
        assert ("LEFT JOIN" not in kws) or ("JOIN" in kws)
        assert row.subcategories


def test_single_labels_agree_with_the_log(spark):
    df = spark.createDataFrame([("select a from b join c",), (None,)], "sql string")
    sql = F.col("sql")
    alone = df.select(L.sql_keywords(sql).alias("k"), L.sql_category(sql).alias("c"), L.sql_table_count(sql).alias("t"))
    full = label_query_log(df).select("keywords", "category", "table_count")
    assert [tuple(r) for r in alone.collect()] == [tuple(r) for r in full.collect()]


def test_every_keyword_occurs(spark, sf):
    seen = {r.k for r in registry.labelled_log(spark, sf).select(F.explode("keywords").alias("k")).distinct().collect()}
    assert seen == set(SQL_KEYWORDS)
