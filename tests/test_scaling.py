from collections import Counter

from pyspark.sql import functions as F

from hintwise.operators import sampling, scaling


def test_lookup_join_both_ways(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    dictionary = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1)], "key string, v bigint"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, big.join(dictionary, "key", how).select("id", "key", "v").collect()))
        for limit in (None, -1):
            got = scaling.lookup_join(big, dictionary, "key", how, limit)
            assert Counter(map(tuple, got.select("id", "key", "v").collect())) == want
    hot = {r.key for r in scaling.hot_keys(big, "key", 0.2).collect()}
    assert hot == {"hot"}


def test_dense_positions(spark):
    keys = spark.range(5000).select(F.concat(F.lit("name"), "id").alias("key"))
    got = scaling.dense_positions(keys, "key").collect()
    assert sorted(r.position for r in got) == list(range(5000))


def test_average_ranks(spark):
    values = [0.5] * 40 + [float(i % 37) for i in range(300)] + [-1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.rank for r in scaling.average_ranks(df, "v").collect()}
    ordered = sorted(values)
    for v in set(values):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert got[v] == sum(places) / len(places)
    counted = df.groupBy("v").agg(F.count("*").alias("w"))
    assert {r.v: r.rank for r in scaling.average_ranks(counted, "v", "w").collect()} == got


def test_ranks_search_no_cuts(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    text = scaling.average_ranks(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in text and "percentile" not in text


def test_label_codes_by_ranges(spark):
    """The same codes as one window over the sorted labels, from several ranges."""
    from pyspark.sql import Window as W

    from hintwise.operators.encoding import fit_label_dict

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(30_000).select(F.concat(F.lit("name"), F.col("id") % 9000).alias("a"), (F.col("id") % 7).alias("b"),
                                        F.lit(None).cast("string").alias("none"))
        got = {(r.head, r.idx, r.label) for r in fit_label_dict(df, {"x": "a", "y": "b", "z": "none"}).collect()}
        codes = F.row_number().over(W.orderBy("label")) - 1
        want = {("x", r.idx, r.label) for r in df.select(F.col("a").alias("label")).distinct().select("label", codes.alias("idx")).collect()}
        assert got == want | {("y", i, str(i)) for i in range(7)}
        dealt = scaling.by_ranges(df.select("a").distinct(), "a")
        assert dealt.select("_b").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sample_is_the_top_of_the_hash_order(spark):
    df = spark.range(20_000)
    ordered = [r.id for r in df.orderBy(sampling.seeded_md5(sampling.SEED, F.col("id")), "id").collect()]
    for n in (0, 1, 137, 5000, 19_999, 20_000, 50_000):
        rows = [r.id for r in sampling.sample_n(df, "id", n).collect()]
        assert len(rows) == min(n, 20_000) and set(rows) == set(ordered[:n])


def test_split_shares(spark):
    report = {r.split: r for r in sampling.split_report(sampling.split_train_val_test(spark.range(40_000), "id")).collect()}
    assert sum(r.rows for r in report.values()) == 40_000
    for name, share in (("train", 0.7), ("val", 0.1), ("test", 0.2)):
        assert abs(report[name].share - share) < 0.01


def test_compute_once_keeps_filters_above(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("s"))
    once = scaling.compute_once(df, {"u": F.upper("s")}).where("u <> '3'")
    assert once.count() == 9
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


def test_large_lookups_have_more_tasks(spark, monkeypatch):
    """A task of a lookup by shuffle joins about ``LOOKUP_ROWS`` rows, whatever the number of rows."""
    monkeypatch.setattr(scaling, "LOOKUP_ROWS", 10)
    big = spark.createDataFrame([(i, f"k{i}") for i in range(230)] + [(-1, None), (-2, "k3")], "i int, k string")
    words = spark.createDataFrame([(f"k{i}", i) for i in range(0, 230, 2)], "k string, v int")
    met = scaling.lookup_join(big, words, "k", "left", small=False)
    got = {r.i: r.v for r in met.collect()}
    assert got == {**{i: i if i % 2 == 0 else None for i in range(230)}, -1: None, -2: None}
    assert "hashpartitioning(k#" in (plan := met._jdf.queryExecution().executedPlan().toString()) and ", 24)" in plan


def test_words_of_large_texts_are_counted_in_more_tasks(spark, monkeypatch):
    from hintwise.operators import ranking

    docs = spark.createDataFrame([(f"t{i}", "one two two") for i in range(40)], "table string, doc string")
    assert ranking.text_parts(docs, "doc") is None
    monkeypatch.setattr(ranking, "PART_CHARS", 20)
    assert ranking.text_parts(docs, "doc") == 22
    counted = ranking.term_counts(docs, "table", "doc", 22)
    assert counted.count() == 80 and "22), REPARTITION_BY_NUM" in counted._jdf.queryExecution().executedPlan().toString()
