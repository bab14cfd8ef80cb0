"""SimHash, substring dedup, language ID and token output against brute force and round trips."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import edge
import numpy as np
import pandas as pd
import pytest

from hintwise.llm import language_id, simhash, substring_dedup, token_output


@pytest.fixture(scope="module", params=["edge", "corpus"])
def docs(request, spark, sf):
    return edge.documents(spark) if request.param == "edge" else spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df, *columns):
    return df.select("doc_id", *columns).collect()


def key(row):
    return tuple((x is not None, x) for x in row)


# --- simhash ---

def brute_fingerprint(text):
    import xxhash

    w = brute.words((text or "").translate(brute.TABLE))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, most=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if bin(a ^ b).count("1") <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_near_duplicates(docs):
    rows = pairs(docs, "text")
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[roots[f]] = min(least.get(roots[f], r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fps)]
    found = simhash.near_duplicates(docs)
    got = [tuple(r) for r in found.select("doc_id", simhash.hex_digits(found.fp), "component_id").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_links_lose_nothing(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            f = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & mask).count("1") <= 3}
    assert got == want and len(want) > 100


def test_codewords_cover_all_words():
    words = np.arange(1 << 22, dtype=np.uint64) << np.uint64(42)
    index = simhash.codewords(words[::977].view(np.int64), 2)
    for word, row in zip((words[::977] >> np.uint64(42)).tolist(), index.tolist()):
        full = []
        for i in set(row):
            data = i << simhash.CHECK_BITS
            full.append(data | simhash.syndrome(data))
        assert all(simhash.syndrome(c) == 0 for c in full)
        assert min(bin(c ^ word).count("1") for c in full) <= 3
        assert all(bin(c ^ word).count("1") <= 4 for c in full)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_first_of_groups(docs):
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    rows = pairs(docs, "text")
    fps = {brute_fingerprint(r.text) for r in rows}
    assert kept.count() == len(set(brute_components(fps).values()))
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    assert want == {i for i in ids if i is not None}


# --- substring dedup ---

def brute_dedup(texts, window):
    split = [brute.words(t) for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("window,group,buckets", [(35, 4, None), (6, 2, 3)])
def test_remove_repeats(docs, window, group, buckets):
    rows = pairs(docs, "text")
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_dedup([r.text for r in rows], window))]
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs.repartition(3), window, group, buckets).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def phrase_texts():
    """One phrase in a third of the texts, in different surroundings; some passages and whole texts twice."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijk", k=5))
    phrase, passage = "the one common phrase", " ".join(word() for _ in range(60))
    texts = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(20, 120))]
        if i % 3 == 0:
            words.insert(len(words) // 2, phrase)
        if i % 25 == 0:
            words.insert(5, passage)
        texts.append(" ".join(words))
    return texts + texts[:4] + texts[:1]


@pytest.mark.parametrize("bucket_bytes", [1, 3000, 1 << 25])
def test_large_buckets_are_dealt_again(spark, bucket_bytes):
    texts = phrase_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, *x) for i, x in enumerate(brute_dedup(texts, 35))]
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, 35, 4, 5, bucket_bytes).collect()]
    assert sorted(got) == want and any(x[2] for x in want)


def test_no_bucket_gathers_more_than_its_bytes(monkeypatch):
    """However often one minimiser occurs, what is held of its bucket stays below the bound."""
    gathered, settle = [], substring_dedup._bucket_ranges

    def counting(rows, window):
        import zstandard
        gathered.append(sum(zstandard.frame_content_size(b) for b in rows["packed"]))
        return settle(rows, window)

    monkeypatch.setattr(substring_dedup, "_bucket_ranges", counting)
    held = {}
    texts = [t.encode() for t in phrase_texts()]
    for t, start, n, least, packed in substring_dedup.super_kmers(texts, 35, 4):
        held.setdefault(packed, (7, []))[1].append((t, 0, start, n))
    parts = [dict(list(held.items())[i::10]) for i in range(10)]
    batch = pd.concat([substring_dedup._dealt(p, 3) for p in parts])
    total = sum(map(len, held))
    for bound in (total // 4, 2 * total):
        gathered.clear()
        out = pd.concat(list(substring_dedup._read_buckets(35, bound)(iter([batch]))))
        assert all(n <= bound for n in gathered)
        assert out["digest"].notna().any() == (bound < total)


def test_equal_hashes_of_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_chained", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    strings = [b"a b c d", b"x b c d e", b"b c d"]
    string, word = substring_dedup.repeated_in_bucket(strings, [False] * 3, 3)
    assert sorted(zip(string.tolist(), word.tolist())) == [(0, 1), (1, 1), (2, 0)]


# --- language ID ---

def test_language_model_is_a_distribution(spark):
    texts = [("en", "the cat sat on the mat and the dog ran"), ("de", "der hund und die katze sind nicht hier")] * 3
    counts = language_id.count_runs(spark.createDataFrame(texts, "lang string, text string")).toPandas()
    model = language_id.build(counts)
    symbols = np.unique(counts["key"].to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFF))
    for context in ("the", "   ", "d u", "qqq"):
        key = 0
        for c in context:
            key = key << 16 | ord(c)
        total = np.exp(model.log_probabilities(np.uint64(key << 16) | symbols)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-4)


def brute_kneser_ney(texts, order=4):
    """Interpolated Kneser-Ney with absolute discounts, from dictionaries: a function of (run of characters)."""
    def runs(text):
        t = "   " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [t[i - order + 1:i + 1] for i in range(order - 1, len(t))]

    counts = {order: Counter(r for t in texts for r in runs(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(r[1:] for r in counts[n + 1])
    alphabet = {r[-1] for r in counts[order]}

    def probability(run):
        n = len(run)
        if not n:
            return 1 / len(alphabet)
        held = list(counts[n].values())
        once, twice = held.count(1), held.count(2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = {r: c for r, c in counts[n].items() if r[:-1] == run[:-1]}
        shorter = probability(run[1:])
        if not after:
            return shorter
        total = sum(after.values())
        return max(after.get(run, 0) - discount, 0) / total + discount * len(after) / total * shorter

    return probability, alphabet


def test_model_against_brute_force_kneser_ney(spark):
    said = {"en": ["The cat sat on the mat.", "A cat and a dog ran"], "de": ["Der Hund und die Katze", "die Katze saß da!"]}
    rows = [(lang, t) for lang, ts in said.items() for t in ts]
    model = language_id.build(language_id.count_runs(spark.createDataFrame(rows, "lang string, text string")).toPandas())
    assert model.languages == ["de", "en"]
    alphabet = brute_kneser_ney([t for ts in said.values() for t in ts])[1]
    for column, lang in enumerate(model.languages):
        runs = {"the ", " the", "katz", "saß ", "   t", "xyz ", "e ca", "qqqq", "a do", "d un", "ie k"}
        keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(r)) for r in runs], np.uint64)
        got = np.exp(model.log_probabilities(keys)[:, column])
        for r, p in zip(runs, got):
            assert p == pytest.approx(brute_over(said[lang], r, len(alphabet)), rel=1e-4), (lang, r)


def brute_over(texts, run, alphabet):
    """The brute-force probability with the evenly spread rest over a given number of characters."""
    probability, own = brute_kneser_ney(texts)
    shift = (1 / alphabet) - (1 / len(own))

    def rest(r):  # how much of the probability comes from the even spread
        if not r:
            return 1.0
        counts = brute_counts(texts)
        held = list(counts[len(r)].values())
        once, twice = held.count(1), held.count(2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = [c for x, c in counts[len(r)].items() if x[:-1] == r[:-1]]
        return rest(r[1:]) * (discount * len(after) / sum(after) if after else 1.0)

    return probability(run) + rest(run) * shift


def brute_counts(texts, order=4):
    out = {order: Counter()}
    for text in texts:
        t = "   " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        out[order].update(t[i - order + 1:i + 1] for i in range(order - 1, len(t)))
    for n in range(order - 1, 0, -1):
        out[n] = Counter(r[1:] for r in out[n + 1])
    return out


def test_many_languages_make_a_small_model():
    """A hundred languages with 20,000 runs of their own each."""
    rng = np.random.default_rng(1)
    parts = []
    for i in range(100):
        letters = rng.integers(0x4E00 + 100 * i, 0x4E00 + 100 * i + 60, (20_000, 4)).astype(np.uint64)
        keys = np.unique(sum(letters[:, k] << np.uint64(16 * k) for k in range(4)))
        parts.append(pd.DataFrame({"lang": f"l{i:03d}", "key": keys.view(np.int64), "n": rng.integers(1, 9, len(keys))}))
    model = language_id.build(pd.concat(parts))
    assert len(model.languages) == 100 and model.nbytes < 200 << 20
    texts = ["".join(chr(0x4E00 + 100 * i + j % 60) for j in range(200)) for i in (0, 41, 99)]
    assert np.argmin(model.cross_entropies(texts)[0], axis=1).tolist() == [0, 41, 99]


def test_too_large_a_model_is_refused(spark, monkeypatch):
    model = language_id.build(language_id.count_runs(spark.createDataFrame([("en", "some text")], "lang string, text string")).toPandas())
    monkeypatch.setattr(language_id, "MOST_MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="fewer texts"):
        language_id.predict(edge.documents(spark), model)


def test_languages(docs, spark):
    train = docs.where(~language_id.held_out() & docs.lang.isNotNull())
    model = language_id.fit(train)
    rows = language_id.predict(docs, model, ("text", "lang")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    if docs.count() > 150:
        held = [r.lang == r.lang_pred for r in language_id.predict(docs.where(language_id.held_out()), model, ("lang",)).collect()]
        assert sum(held) / len(held) > 0.97
        assert sum(r.rejected for r in rows if any(c.isalpha() for c in r.text or "")) <= 0.02 * len(rows)


def test_gibberish_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    odd = "xqzjk vvwwq zzxxq jjqqk " * 20
    got = language_id.predict(spark.createDataFrame([(1, odd)], "doc_id long, text string"), model).first()
    assert got.rejected


def test_scores_do_not_depend_on_neighbours(spark, docs):
    model = language_id.build(language_id.count_runs(docs).toPandas())
    texts = [t for t in ("abc def", "12 the mat!", "x", "été\x00a", " ", "der  Hund.\n\nund")]
    together = model.cross_entropies(texts)[0]
    for i, t in enumerate(texts):
        assert np.allclose(model.cross_entropies([t])[0][0], together[i])


# --- token output ---

def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        for high in (1, 255, 49408, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
            for width in (1, 8):
                assert (token_output.decode_chunk(token_output.encode_chunk(ids, width)) == ids).all()


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_words_encode_like_texts():
    texts = [*edge.TEXTS, "it's They'LL <|endoftext|>x a<|startoftext|> İstanbul ΣΑΣ ſ ǅ é Å \xa0x\x85y ² ½ a1b2 日本語。 x​y ’s -- ''s", "á.,!? ÀÖ.,; ß|"]
    encoder = token_output.WordEncoder(token_output.tokenizer_path())
    for t, want in zip(texts, whole_ids(texts)):
        assert np.frombuffer(encoder.encode(t or ""), "<u4").tolist() == want[:-1], t


@pytest.mark.parametrize("chunk", [1 << 16, 100])
def test_token_files(docs, chunk):
    rows = pairs(docs, "text")
    ids = {i: v for i, v in enumerate(whole_ids([r.text for r in rows]))}
    want = sorted([(r.doc_id, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, r in enumerate(rows)], key=key)
    got = token_output.encoded_documents(docs, chunk_ids=chunk).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_empty_tables(spark):
    none = edge.empty(spark)
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_groups(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert token_output.encoded_documents(none).count() == 0
    model = language_id.fit(none)
    assert language_id.predict(none, model).count() == 0
    one = language_id.predict(edge.documents(spark), model).first()
    assert (one.lang_pred, one.score, one.rejected) == ("und", 0.0, True)
