"""Catalogs that change: frequencies by deltas, versions, and streams that take up new ones."""

import os

import pytest

from hintwise.operators import catalog_store, ranking
from hintwise.operators.catalog_store import CatalogStore
from hintwise.plans import registry
from hintwise.streaming.analyze import analyze_stream

ENTRIES = [("orders", "orders of customers with dates"), ("people", "names of people"), ("logs", "server logs with dates"), ("blank", None)]


def entries(spark, rows):
    return spark.createDataFrame(rows, "table string, doc string")


def ranked(df):
    return sorted((r.query_id, r.rank, r.table, round(r.score, 9)) for r in df.collect())


def test_changes_equal_a_full_fit(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/store")
    assert store.latest() is None
    with pytest.raises(ValueError):
        store.change()
    assert store.publish(entries(spark, ENTRIES)) == 0
    added = [("logs", "logs of customers"), ("new", "people and dates and people")]
    assert store.change(entries(spark, added), spark.createDataFrame([("people",), ("absent",)], "table string")) == 1
    now = [("orders", "orders of customers with dates"), ("blank", None), *added]
    for version, rows in ((0, ENTRIES), (1, now)):
        full = ranking.token_document_frequency(entries(spark, rows), "table", "doc").collect()
        held = catalog_store.inverse_frequencies(spark.read.parquet(f"{tmp_path}/store/version={version}/frequencies")).collect()
        assert {(r.token, r.df, round(r.idf, 12)) for r in held} == {(r.token, r.df, round(r.idf, 12)) for r in full}
        asked = spark.createDataFrame([(1, "dates of customers"), (2, "people"), (3, "")], "query_id bigint, text string")
        want = ranked(ranking.rank_by_text(asked, entries(spark, rows), 3))
        assert ranked(ranking.rank_by_text(asked, store.load(version), 3)) == want
    # dropping everything leaves an empty catalog
    assert store.change(dropped=entries(spark, now).select("table")) == 2
    assert spark.read.parquet(f"{tmp_path}/store/version=2/frequencies").count() == 0
    assert store.versions() == [0, 1, 2]


def test_unfinished_versions_do_not_count(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/store")
    store.publish(entries(spark, ENTRIES))
    entries(spark, ENTRIES).write.parquet(f"{tmp_path}/store/version=1/entries")
    assert store.latest() == 0 and store.publish(entries(spark, ENTRIES[:1])) == 2 and store.latest() == 2


def test_stream_takes_up_new_versions_and_replays_old_answers(spark, sf, tmp_path):
    model = registry.analyzer(spark, sf)
    store = CatalogStore(spark, f"{tmp_path}/store")
    store.publish(entries(spark, ENTRIES))

    def arrive(i):
        spark.createDataFrame([(i, "Find customers with dates"), (10 + i, "logs")], "query_id bigint, text string").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("query_id bigint, text string").parquet(f"{tmp_path}/in")
        analyze_stream(stream, model, store, f"{tmp_path}/out", f"{tmp_path}/progress", top_k=1, available_now=True).awaitTermination()
        return {r.query_id: r.tables[0]["table"] if r.tables and "table" in r.tables[0] else r.tables[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    arrive(1)
    assert "orders" in str(run()[1])
    store.change(entries(spark, [("clients", "customers with dates")]), entries(spark, ENTRIES[2:3]).select("table"))
    arrive(2)
    second = run()
    assert "orders" in str(second[1]) and "clients" in str(second[2])
    # the second batch is replayed after yet another change, and answers as it did
    store.change(entries(spark, [("late", "find customers with dates")]))
    os.remove(f"{tmp_path}/progress/commits/1")
    for name in os.listdir(f"{tmp_path}/progress/commits"):
        if name.startswith(".1.crc"):
            os.remove(f"{tmp_path}/progress/commits/{name}")
    assert run() == second
    arrive(3)
    third = run()
    assert "late" in str(third[3]) and {k: v for k, v in third.items() if k in second} == second
