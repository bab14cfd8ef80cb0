import numpy as np
import pytest
from pyspark.sql import functions as F

from hintwise.operators import blocks, hints, ranking, scaling
from hintwise.operators.blocks import grid_shape
from hintwise.plans import registry, serving
from hintwise.sources import derived


def brute(questions, catalog, k):
    """{query: [(table, score)]} by cosine and then name."""
    out = {}
    for q, v in questions:
        scored = []
        for t, w in catalog:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((t, round(float(np.dot(v, w) / size), 9) + 0.0 if size else 0.0))
        out[q] = sorted(scored, key=lambda e: (-e[1], e[0]))[:k]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.table, r.score))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    questions = [(i, rng.normal(size=8).round(3).tolist()) for i in range(57)]
    catalog = [(f"t{i:03d}", rng.normal(size=8).round(3).tolist()) for i in range(91)]
    catalog += [(f"copy{i:02d}", catalog[4][1]) for i in range(30)] + [("zero", [0.0] * 8)]
    questions.append((99, [0.0] * 8))
    return (
        questions, catalog,
        spark.createDataFrame(questions, "query_id bigint, vec array<double>"),
        spark.createDataFrame(catalog, "table string, vec array<double>"),
    )


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [t for t, _ in got[q]] == [t for t, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-9)


@pytest.mark.parametrize("pack", [1024, 16])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_k(data, monkeypatch, pack, k):
    monkeypatch.setattr(blocks, "PACK_ROWS", pack)
    questions, catalog, q, c = data
    same(collected(ranking.rank_top_k(q, c, k, min_score=-1.0)), brute(questions, catalog, k))


def test_small_blocks_by_values(data, monkeypatch):
    monkeypatch.setattr(blocks, "PACK_VALUES", 50)
    questions, catalog, q, c = data
    same(collected(ranking.rank_top_k(q, c, 5, min_score=-1.0)), brute(questions, catalog, 5))


@pytest.mark.parametrize("pack", [1024, 16])
def test_rows_with_one_id_stay_apart(spark, data, monkeypatch, pack):
    monkeypatch.setattr(blocks, "PACK_ROWS", pack)
    questions, catalog, _, c = data
    twice = spark.createDataFrame([(5, questions[0][1]), (5, questions[1][1])], "query_id bigint, vec array<double>")
    want = brute(questions[:2], catalog, 2)
    got = sorted((r.table, r.rank) for r in ranking.rank_top_k(twice, c, 2, -1.0).collect())
    assert got == sorted((t, i + 1) for q in (0, 1) for i, (t, _) in enumerate(want[q]))


@pytest.mark.parametrize("pack", [1024, 16])
def test_packed_once_ranked_often(data, monkeypatch, pack):
    monkeypatch.setattr(blocks, "PACK_ROWS", pack)
    questions, catalog, q, c = data
    ready = blocks.pack_catalog(c, "table", "vec")
    monkeypatch.setattr(blocks, "pack_catalog", None)
    for k in (1, 5):
        same(collected(ranking.rank_top_k(q, ready, k, -1.0)), brute(questions, catalog, k))


def test_qualified_names(spark, data):
    columns = spark.createDataFrame([("sales.orders", "a.id", [1.0] * 8), ("sales", "orders.x", [-1.0] + [0.0] * 7)], "table string, column string, vec array<double>")
    got = ranking.rank_columns(data[2], columns, 2, -1.0).collect()
    assert {(r.table, r.column) for r in got} == {("sales.orders", "a.id"), ("sales", "orders.x")}


def test_min_score_after_top_k(data):
    _, _, q, c = data
    full = ranking.rank_top_k(q, c, 3, min_score=-1.0)
    kept = ranking.rank_top_k(q, c, 3, min_score=0.6)
    assert collected(kept) == collected(full.where("score >= 0.6"))


def test_top_k_is_a_prefix(data):
    _, _, q, c = data
    every = collected(ranking.rank_all(q, c))
    assert {k: v[:4] for k, v in every.items()} == collected(ranking.rank_top_k(q, c, 4, -1.0))


def test_missing_vector_scores_zero(spark, data):
    _, _, _, c = data
    q = spark.createDataFrame([(1, None)], "query_id bigint, vec array<double>")
    assert {r.score for r in ranking.rank_all(q, c).collect()} == {0.0}


@pytest.mark.parametrize("pack,held", [(1024, 16), (32, 16), (32, 2)])
def test_text_grid(spark, sf, monkeypatch, pack, held):
    """Text ranking by blocks against token sums in plain Python, ties and zero scores included; a catalog
    beyond one cell is packed by its terms."""
    import math
    import re
    from collections import Counter

    monkeypatch.setattr(blocks, "PACK_ROWS", pack)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", held)
    monkeypatch.setattr(blocks, "TERM_CHUNK", 64)
    questions = registry.benchmark_questions(spark, sf)
    docs = registry.document_catalog(spark, sf)
    got = collected(ranking.rank_by_text(questions, docs, 5))

    def words(text):
        return Counter("".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in text.lower()).split())

    catalog = {r.table: words(r.doc) for r in docs.collect()}
    df = Counter(w for d in catalog.values() for w in d)
    idf = {w: math.log((len(catalog) + 1) / (n + 1)) + 1 for w, n in df.items()}

    def weigh(counts):
        v = {w: n * idf[w] for w, n in counts.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    weighed = {t: weigh(d) for t, d in catalog.items()}
    for r in questions.collect():
        q = weigh(words(r.text))
        scored = [(t, round(sum(x * d.get(w, 0.0) for w, x in q.items()), 9)) for t, d in weighed.items()]
        want = sorted(scored, key=lambda e: (-e[1], e[0]))[:5]
        assert np.allclose([s for _, s in got[r.query_id]], [s for _, s in want], atol=2e-9)
    assert re.fullmatch(r"doc_\d+", next(iter(got.values()))[0][0])


def test_grid_shape():
    assert grid_shape(1, 1000, 64) == (64, 1)
    assert grid_shape(1000, 1, 64) == (1, 64)
    rows, columns = grid_shape(500, 500, 64)
    assert rows == columns == 8


def sparse_blocks(rng, n, width, size, per_block):
    """Blocks of unit vectors over ``width`` terms, as a cell holds them; neighbours share their terms."""
    import pyarrow as pa

    vectors = []
    for i in range(n):
        first = (i * width) // n
        terms = np.sort(rng.choice(np.arange(max(0, first - 6), min(width, first + 6)), size, replace=False))
        weights = rng.random(size) + 0.1
        vectors.append((terms, weights / np.linalg.norm(weights)))
    out = []
    for at in range(0, n, per_block):
        part = vectors[at:at + per_block]
        terms, weights = np.concatenate([t for t, _ in part]), np.concatenate([w for _, w in part])
        known, place = np.unique(terms, return_inverse=True)
        peaks = np.zeros(len(known))
        np.maximum.at(peaks, place, weights)
        out.append(blocks._Block(at, pa.array([f"t{(7 * i) % n:05d}" for i in range(at, at + len(part))]),
                                 np.arange(0, size * len(part) + 1, size), terms, weights, known, peaks))
    return vectors, out


@pytest.mark.parametrize("k", [1, 3, 500])
def test_cells_skip_what_bounds_exclude(k):
    """The same best entries as without bounds, from fewer products; no more than k per question."""
    rng = np.random.default_rng(2)
    vectors, held = sparse_blocks(rng, 400, 100, 4, 40)
    asked_vectors, asked = sparse_blocks(rng, 30, 100, 4, 30)
    ids = [x for b in held for x in b.ids.to_pylist()]
    names = np.argsort(np.argsort(ids))
    best, entry, multiplied = blocks.cell_best(asked[0], held, k, True, names, np.arange(0, 400, 40))
    assert entry.shape == (30, k)
    for q, (terms, weights) in enumerate(asked_vectors):
        scored = []
        for i, (t, w) in enumerate(vectors):
            held_weights = dict(zip(t.tolist(), w))
            scored.append((-round(sum(x * held_weights.get(j, 0.0) for j, x in zip(terms.tolist(), weights)), 9), ids[i], i))
        want = sorted(scored)[:k]
        assert [e for e in entry[q] if e >= 0] == [i for _, _, i in want]
        assert np.allclose(best[q][:len(want)], [-x for x, _, _ in want], atol=2e-9)
    assert multiplied <= 30 * 10 and (k > 3 or multiplied < 30 * 5)


def test_at_most_k_rows_per_question_and_cell(spark, data, monkeypatch):
    monkeypatch.setattr(blocks, "PACK_ROWS", 8)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", 4)
    counted, scored = [], blocks._score_cells

    def counting(cells, *args):
        out = scored(cells, *args)
        counted.append((out, cells.where("_asked = 1").count(), cells.where("_asked = 0").select("_row").distinct().count()))
        return out

    monkeypatch.setattr(blocks, "_score_cells", counting)
    questions, catalog, q, c = data
    same(collected(ranking.rank_top_k(q, c, 2, -1.0)), brute(questions, catalog, 2))
    out, _, cells = counted[0]
    per_question = out.groupBy("block", "at").count()
    assert per_question.where(F.col("count") > 2 * cells).isEmpty() and 4 <= cells < 16


@pytest.mark.parametrize("held,group", [(2, 1 << 15), (4, 7), (16, 1)])
@pytest.mark.parametrize("k", [2, 1000])
def test_best_of_all_without_a_grid(spark, data, monkeypatch, held, group, k):
    """Where a grid would copy too much: ties go by name across all blocks, and only questions are shuffled."""
    monkeypatch.setattr(blocks, "PACK_ROWS", 8)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", held)
    monkeypatch.setattr(blocks, "GROUP_ROWS", group)
    monkeypatch.setattr(blocks, "GRID_VALUES", 0)
    monkeypatch.setattr(blocks, "_score_cells", None)
    questions, catalog, q, c = data
    ranked = ranking.rank_top_k(q, c, k, -1.0)
    same(collected(ranked), brute(questions, catalog, k))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1 and "Window" not in plan


def test_best_texts_without_a_grid(spark, sf, monkeypatch):
    texts = [f"{a} {b} {c}" for a in ("red", "blue", "grey") for b in ("box", "can", "jar", "box") for c in ("big", "small", f"n{a}")]
    catalog = spark.createDataFrame([(f"t{(7 * i) % 97}", t) for i, t in enumerate(texts)], '"table" string, doc string'.replace('"', ""))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[::3], "unknown", "", None, "box box jar"])], "query_id bigint, text string")
    monkeypatch.setattr(blocks, "PACK_ROWS", 4)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", 2)
    want = ranking.rank_by_text(asked, catalog, 5).collect()
    monkeypatch.setattr(blocks, "GRID_VALUES", 0)
    monkeypatch.setattr(blocks, "_score_cells", None)
    assert sorted(ranking.rank_by_text(asked, catalog, 5).collect()) == sorted(want) and len(want) == 5 * 16


@pytest.mark.parametrize("pack", [1024, 16])
def test_whole_rankings(spark, data, monkeypatch, pack):
    monkeypatch.setattr(blocks, "PACK_ROWS", pack)
    questions, catalog, q, c = data
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(collected(ranking.rank_all(q, c)), brute(questions, catalog, None))
        twice = spark.createDataFrame([(5, questions[0][1]), (5, questions[0][1])], "query_id bigint, vec array<double>")
        got = sorted((r.rank, r.table) for r in ranking.rank_all(twice, c).collect())
        assert got == sorted((i + 1, t) for i, (t, _) in enumerate(brute(questions[:1], catalog, None)[0]) for _ in range(2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("held,names", [(1, blocks.RANKED_NAMES), (1 << 20, blocks.RANKED_NAMES), (1, 0)])
def test_whole_rankings_by_groups_of_questions(spark, data, monkeypatch, held, names):
    """One question or several blocks of them in a task; names that a task may not hold; ties, a name that is null, vectors with a null."""
    monkeypatch.setattr(blocks, "PACK_ROWS", 4)
    monkeypatch.setattr(blocks, "RANKED_SCORES", held)
    monkeypatch.setattr(blocks, "RANKED_NAMES", names)
    monkeypatch.setattr(blocks, "RANKED_BATCH", 7)
    questions, catalog, q, c = data
    same(collected(ranking.rank_all(q, c)), brute(questions, catalog, None))
    odd = spark.createDataFrame([(None, catalog[4][1]), ("unknown", [None, 1.0]), ("nothing", None)], "table string, vec array<double>")
    want = {i: [("unknown", None), *sorted([*v, (None, dict(v)["t004"]), ("nothing", 0.0)], key=lambda e: (-e[1], e[0] or ""))]
            for i, v in brute(questions[:20], catalog, None).items()}
    got = collected(ranking.rank_all(q.where("query_id < 20"), c.union(odd)).withColumn("score", F.nanvl("score", F.lit(None))))
    assert {i: [t for t, _ in v] for i, v in got.items()} == {i: [t for t, _ in v] for i, v in want.items()}
    assert {v[0][1] for v in got.values()} == {None}


def test_whole_rankings_shuffle_and_write_no_pairs(data, monkeypatch):
    monkeypatch.setattr(blocks, "PACK_ROWS", 16)
    stored, kept = [], blocks.written
    for module in (blocks, scaling):
        monkeypatch.setattr(module, "written", lambda df, name: stored.append(kept(df, name)) or stored[-1])
    _, catalog, q, c = data
    ranked = ranking.rank_all(q, c)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("CartesianProduct")]
    assert not any(step in above for step in ("Exchange", "Window", "Sort"))
    assert stored and max(df.count() for df in stored) <= len(catalog)


def test_scores_of_listed_pairs(spark, data):
    questions, catalog, q, c = data
    every = {(r.query_id, r.table): r.score for r in ranking.cosine_scores(q, c).collect()}
    pairs = [(0, "t004"), (0, "t004"), (3, "copy07"), (99, "t001"), (5, "zero"), (5, "absent"), (12345, "t001"), (None, "t001"), (6, None)]
    listed = spark.createDataFrame(pairs, "query_id bigint, table string")
    scores = ranking.cosine_scores(q, c, listed)
    got = sorted(((r.query_id, r.table, r.score) for r in scores.collect()), key=repr)
    assert got == sorted(((i, t, every.get((i, t))) for i, t in pairs), key=repr)
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_hint_views(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "a", 0.8), (1, 2, "b", 0.4), (1, 3, "a", 0.2), (2, 1, "c", -0.5)],
        "query_id bigint, rank int, table string, score double",
    )
    assert {r.query_id: r.tables for r in hints.hint_names(ranked).collect()} == {1: ["a", "b", "a"], 2: ["c"]}
    assert {r.query_id: r.scores for r in hints.hint_scores(ranked).collect()} == {1: {"a": 0.2, "b": 0.4}, 2: {"c": -0.5}}
    boosts = [(r.query_id, r.boost) for r in hints.hints_boost(ranked, 2.0).orderBy("query_id", "rank").collect()]
    assert boosts == [(1, 3.0), (1, 2.5), (1, 2.25), (2, 2.0)]
    found = spark.createDataFrame([(1, "a", 10.0), (1, "z", 1.0), (2, "c", 1.0)], "query_id bigint, table string, r double")
    assert hints.apply_filter(found, ranked).count() == 2
    assert {(r.table, r.r) for r in hints.apply_boost(found, ranked, "r").collect()} == {("a", 12.5), ("z", 1.0), ("c", 1.0)}


def test_request_lists(spark):
    requests = spark.createDataFrame(
        [(1, "customer orders", "orders, logs, customer orders"), (2, "", "a"), (3, "anything", "only")],
        "query_id bigint, query string, tables string",
    )
    got = collected(serving.rank_requests(requests, 2))
    assert [t for t, _ in got[1]] == ["customer orders", "orders"] and got[1][0][1] == pytest.approx(1.0)
    assert got[3] == [("only", 0.0)] and 2 not in got


def test_batches_keep_every_question(spark, sf):
    model = registry.analyzer(spark, sf)
    asked = spark.createDataFrame([(1, "Find customers"), (2, "  "), (3, None)], "query_id bigint, text string")
    items = spark.createDataFrame([("t", "customers"), ("u", "logs")], "table string, doc string")
    for c in (items, ranking.fit_catalog(items)):
        got = {r.query_id: r for r in serving.analyze_batch(asked, model, c).collect()}
        assert got.keys() == {1, 2, 3} and all(len(r.tables) == 2 for r in got.values())
    with pytest.raises(ValueError, match="blank_query"):
        serving.analyze(spark, " \t", model)


def test_spread_keeps_rows(spark, sf):
    orders = derived.table(spark, sf, "orders")
    assert derived.spread(orders).count() == orders.count()
    assert derived.spread(spark.range(100, numPartitions=32)).rdd.getNumPartitions() == 32
    assert F is not None


@pytest.mark.parametrize("sparse", [False, True])
def test_only_scores_that_reach_the_best_are_compared(monkeypatch, sparse):
    """Whole blocks are rounded and ordered once; of later ones, what reaches the k-th best score so far. Ties go by name."""
    rng = np.random.default_rng(4)
    if sparse:
        _, held = sparse_blocks(rng, 400, 12, 6, 40)
        _, (asked,) = sparse_blocks(rng, 30, 12, 6, 30)
    else:
        import pyarrow as pa

        def dense(at, n):
            v = rng.integers(-1, 2, (n, 4)) + 0.5
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            none = np.zeros(0)
            return blocks._Block(at, pa.array([f"t{(7 * i) % 400:05d}" for i in range(at, at + n)]), np.arange(0, 4 * n + 1, 4), none, v.ravel(), none, none)

        held, asked = [dense(at, 40) for at in range(0, 400, 40)], dense(0, 30)
    scores = np.hstack([blocks.block_scores(asked, b, sparse) for b in held])
    names = np.argsort(np.argsort([x for b in held for x in b.ids.to_pylist()]))
    rounded, compared = [], blocks.compared
    monkeypatch.setattr(blocks, "compared", lambda x: rounded.append(x.size) or compared(x))
    best, entry, multiplied = blocks.cell_best(asked, held, 5, sparse, names, np.arange(0, 400, 40))
    want = np.lexsort((np.broadcast_to(names, scores.shape), -scores))[:, :5]
    assert (entry == want).all() and (best == np.take_along_axis(scores, want, axis=1)).all()
    assert sum(rounded) < multiplied * 40 / 2


def test_requests_are_dealt_by_their_number(spark, monkeypatch):
    """No task gets more requests than a part holds, and entries' vectors join only after the requests are dealt."""
    monkeypatch.setattr(serving, "PART_REQUESTS", 4)
    requests = spark.createDataFrame([(i, f"orders of customer {i}", "orders, customer, logs") for i in range(90)], "query_id bigint, query string, tables string")
    ranked = serving.rank_requests(requests, 2)
    got = collected(ranked)
    assert len(got) == 90 and all([t for t, _ in v] == ["customer", "orders"] for v in got.values())
    assert "hashpartitioning(query_id#" in (plan := ranked._jdf.queryExecution().executedPlan().toString()) and ", 23)" in plan
