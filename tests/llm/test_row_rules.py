"""Mixing, quality rules and secret scans against brute force."""

import random
import string

import brute
import edge
import pytest
from pyspark.sql import functions as F

from hintwise.llm import mixing, quality_rules, secrets


@pytest.fixture(scope="module", params=["edge", "corpus"])
def docs(request, spark, sf):
    return edge.documents(spark) if request.param == "edge" else spark.read.parquet(f"{sf}/documents.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


def test_quality_counts(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = [(r.doc_id, *(r[n] for n in names)) for r in quality_rules.apply_rules(docs).collect()]
    want = [(r.doc_id, *brute.quality(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_quality_verdicts(spark):
    good = "the plain words of a text that has many different words in it " + " ".join(f"{w}{c}" for w in ("word", "term") for c in "abcdefghijklmnopqrstuvwxyz")
    bad = " ".join(f"w{i}***" for i in range(80))
    df = spark.createDataFrame([(1, good), (2, bad), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed) for r in quality_rules.apply_rules(df).collect()}
    assert got[1] == (True, []) and got[2][0] is False and "symbols" in got[2][1] and got[3][0] is False


def test_stop_words_by_language(spark):
    """Clean texts of listed languages and of other scripts pass; a text of no language's words fails."""
    said = {
        "fi": "talo on suuri ja vanha mutta se ei ole kaunis kun sataa", "ru": "это большой дом и он стоит на горе что не мешает",
        "el": "το σπίτι και η θάλασσα για να δει που δεν είναι", "ar": "هذا بيت كبير جدا في مدينة قديمة على جبل عال",
        "hi": "यह एक बड़ा घर है जो पहाड़ पर पुराना शहर में", "no": "qwrt zxcvb plmkj hgfds mnbvc lkjhg poiuy trewq asdfg",
    }
    rows = [(k, " ".join(f"{w}{c}" if i % 3 == 2 else w for c in "abcdefg" for i, w in enumerate(t.split()))) for k, t in said.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.failed for r in quality_rules.apply_rules(df).collect()}
    assert {k for k, v in got.items() if "stop_words" in v} == {"no"}
    one = quality_rules.apply_rules(df, stop_words={"ru": quality_rules.STOP_WORDS["ru"]}, scripts=("Cyrillic",)).collect()
    assert not any("stop_words" in r.failed for r in one)


def test_repeated_windows_with_equal_hashes(spark, monkeypatch):
    # with one hash for all windows every neighbour clashes and the words decide
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    texts = ["a b c d e f g", "a b c x a b c", "a b c d a b c d a", "a a a a a", "x y z w x y q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(df).collect()}
    assert got == {i: brute.quality(t)[4] for i, t in enumerate(texts)}


def test_secret_spans(docs):
    ratios = [0.0] * len(secrets.ALPHABET) ** 2
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.scan(docs, ratios)).collect()]
    want = [(r.doc_id, *brute.secrets(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_secret_models(spark):
    text = "plain internationalization here Zk3vQ9xB2mW7rT5yL8pN4jH6 and api_key: 'abc' token = é secret=\"dGhpcy1pcy1zZWNyZXQ\""
    random = ["Qx7Lm2Zp9Kd4Vb8Nw3Rt", "h5Gj8Ks1Pq6Wz0Xc4Vb2", "T9rY3uI7oP1aS5dF8gH2"] * 5
    plain = ["internationalization", "characteristically", "reinterpretation"] * 5
    samples = spark.createDataFrame([(s, True) for s in random] + [(s, False) for s in plain], "sample string, random boolean")
    ratios = secrets.fit_ratio(samples)
    row = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratios, 1.0)).first()
    start = text.index("Zk3v")
    assert f"markov:{start}:{start + 24}" in row.spans.split(",")
    assert "international" not in row.spans and row.n_assign == 1
    assert str(text.index("internat")) not in [s.split(":")[1] for s in row.spans.split(",")]


def test_secret_recall_by_length(spark):
    """Held-out random tokens of 16 characters and more are found, held-out identifiers are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ratios = secrets.fit_ratio(secrets.labelled_samples(docs.where(~held)))
    plain = [r.sample for r in secrets.labelled_samples(docs.where(held)).where("NOT random").collect()]
    rng, size = random.Random(3), len(secrets.ALPHABET)
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}

    def flagged(t):
        return sum(ratios[place[a] * size + place[b]] for a, b in zip(t, t[1:])) >= secrets.MARGIN

    for alphabet in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, secrets.ALPHABET):
        for n in (16, 20, 24, 32):
            assert sum(flagged("".join(rng.choices(alphabet, k=n))) for _ in range(500)) >= 0.95 * 500
    joined = ["_".join(rng.choices(plain, k=2)) for _ in range(1000)]
    assert sum(map(flagged, plain + joined)) < 0.01 * len(plain + joined)


def test_added_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, "id Zk3vQ9xB2mW7rT5yL8pN4jH6, Ünicode é q8W2e4R6t1Y3u5I7o9P0 token: Zk3vQ9xB2mW7rT5yL8pN4jH6")], "doc_id long, text string"))
    rng = random.Random(4)
    samples = [("".join(rng.choices(string.ascii_letters + string.digits, k=20)), True) for _ in range(50)]
    samples += [(w, False) for w in ("internationalization", "characteristically", "reinterpretation") * 100]
    ratios = secrets.fit_ratio(spark.createDataFrame(samples, "sample string, random boolean"))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(docs, ratios).collect()}
    assert got == {r.doc_id: brute.all_secrets(r.text, ratios) for r in docs.collect()}
    assert sum(k == 3 for _, k, _ in got[-1]) == 2


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"x{i} password=p{i:09d}é" for i in range(2000))
    ratios = [0.0] * len(secrets.ALPHABET) ** 2
    r = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratios)).first()
    assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(text)


def test_mix_targets_and_sums(docs):
    rows = mixing.mix(docs).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    assert len(rows) == len(texts)
    sizes, taken, largest = {}, {}, {}
    for r in texts:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    target = brute.water_fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    ties = max((sum(1 for x in rows if x.doc_id == 5) or 1), 1)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] * ties / 2 + 1
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_documents_repeat_rows(docs):
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    none = edge.empty(spark)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert quality_rules.apply_rules(none).count() == 0
    assert secrets.scan(none, [0.0] * len(secrets.ALPHABET) ** 2).count() == 0
    assert secrets.fit_ratio(secrets.labelled_samples(none)) == [0.0] * len(secrets.ALPHABET) ** 2
