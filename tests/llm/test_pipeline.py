"""The pipeline's stages: each keeps what it should, and the last one's files hold it all."""

import brute
import edge
import test_models_and_copies as copies
import test_passages_and_scores as passages

import corpus_pipeline



def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "language_id":
            assert len(after) >= 0.98 * sum(any(c.isalpha() for c in r.text or "") for r in before)
        elif name == "near_duplicates":
            roots = copies.brute_components([copies.brute_fingerprint(r.text) for r in before])
            assert len(after) == len(set(roots.values()))
        elif name == "decontamination":
            hits = passages.brute_contamination([(r.doc_id, r.text) for r in before], items, 10)
            assert {r.doc_id for r in after} == {i for i, _, n, _ in hits if not n}
        elif name == "mixing":
            sizes, taken, largest = {}, {}, {}
            for r in before:
                n = len(brute.words(r.text))
                sizes[r.source] = sizes.get(r.source, 0) + n
                largest[r.source] = max(largest.get(r.source, 0), n)
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
            for s, t in brute.water_fill(sizes).items():
                assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1
        else:
            ids = copies.whole_ids([r.text for r in before])
            assert len(after) == len(before)
            assert sum(r.n_tokens for r in after) == sum(map(len, ids))


def test_run_on_awkward_rows(spark, tmp_path):
    edge.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The cat sat on the mat and the cat sat on the mat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens >= 1 for r in rows)
    assert not {0, 1, 2, 5} & {r.doc_id for r in rows}


def test_run_on_nothing(spark, tmp_path):
    edge.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
