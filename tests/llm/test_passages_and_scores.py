"""Decontamination, licence scans and the quality classifier against brute force."""

import hashlib
import re

import brute
import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from hintwise.llm import decontamination, licenses, quality_classifier
from hintwise.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", params=["edge", "corpus"])
def tables(request, spark, sf):
    if request.param == "edge":
        items = [(1, "The cat sat on the mat and the cat sat on the mat"), (2, "one"), (3, None), (4, ""), (5, "Passage1 passage2, passage3"),
                 (5, "w5x5 w6x6"), (None, "two words"), (7, " ".join(f"passage{i}" for i in range(20, 45))), (8, "école été"), (9, "absentword the")]
        return edge.documents(spark), spark.createDataFrame(items, "item_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


def plain(text):
    return WORD.findall((text or "").translate(brute.TABLE))


def brute_contamination(docs, items, length):
    phrases = {}
    for i, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            phrases.setdefault(tuple(w[k:k + length]), set()).add("" if i is None else str(i))
    sizes = {len(p) for p in phrases}
    for i, text in docs:
        w, hit, names = plain(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = phrases.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        yield i, len(w), len(hit), tuple(sorted(names))


def test_contamination(tables):
    docs, items = tables
    plain_docs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    plain_items = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = sorted(brute_contamination(plain_docs, plain_items, 10), key=lambda r: key(r[:3]))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, items).collect()), key=lambda r: key(r[:3]))
    assert got == want
    assert any(r[2] for r in got)


def test_contamination_without_broadcast(tables, monkeypatch):
    docs, items = tables
    want = sorted(map(str, decontamination.contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "small_enough", lambda *a: False)
    assert sorted(map(str, decontamination.contamination(docs, items).collect())) == want


def test_exact_and_near_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item, f"x {item} y", item.replace("gamma", "gamma filler"), "alpha kappa", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    exact = {(r.doc_id, r.kind, r.start) for r in decontamination.matches(docs, items).collect()}
    assert exact == {(0, "exact", 0), (1, "exact", 1)}
    near = {(r.doc_id, r.kind) for r in decontamination.matches(docs, items, slack=2).collect()}
    assert near == {(0, "exact"), (1, "exact"), (2, "near")}


def brute_near(docs, items, length, slack):
    """{(doc_id, kind, start, phrase)} by trying every start of every text."""
    out = set()
    for _, item in items:
        w = plain(item)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            window = w[i:i + length]
            own = set(window)
            for doc_id, text in docs:
                d, run = plain(text), []
                for s in range(-slack, len(d) + slack + 1):
                    wide = d[max(s - slack, 0):max(s + len(window) + slack, 0)]
                    if len(own & set(wide)) >= 0.8 * len(own):
                        inside = len(own & set(d[max(s, 0):max(s + len(window), 0)]))
                        run.append((s >= 0 and d[s:s + len(window)] == window, inside, -s))
                    elif run:
                        out.add((doc_id, "exact" if max(run)[0] else "near", -max(run)[2], " ".join(window)))
                        run = []
                if run:
                    out.add((doc_id, "exact" if max(run)[0] else "near", -max(run)[2], " ".join(window)))
    return out


def test_near_matches_with_each_word_replaced(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    short, tied = "one two three", "a b a b a b a b c d"
    w = item.split()
    texts = [item, f"x {item} y", item.replace("gamma", "gamma filler"), "alpha kappa", "nothing", None, "", short, "one three", tied]
    # every word replaced in turn, by a word of the corpus and by one that is new; two words; three words
    texts += [f"before {' '.join(w[:i] + [new] + w[i + 1:])} after" for i in range(10) for new in ("alpha", f"new{i}")]
    texts += [" ".join(w[:i] + ["gone"] * 2 + w[i + 2:]) for i in range(9)] + [" ".join(w[:i] + ["gone"] * 3 + w[i + 3:]) for i in range(8)]
    texts += ["alpha alpha alpha beta " * 30, " ".join(["pad"] * 500 + w[1:] + ["pad"] * 10 + w[:9]), f"{item} {item}"]
    texts += [" ".join(reversed(w)), "a b a b x a b c d a b c"]
    rows = list(enumerate(texts))
    # words that no text has count as missing
    items = [(1, item), (2, short), (3, tied), (4, "alpha beta gamma delta epsilon zeta eta theta absent1 absent2"),
             (5, "alpha beta gamma delta epsilon zeta eta absent1 absent2 absent3"), (6, None), (7, f"{item} lambda mu")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    found = decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string"), slack=2).collect()
    got = [(r.doc_id, r.kind, r.start, r.phrase) for r in found]
    want = brute_near(rows, [(i, t or "") for i, t in items], 10, 2)
    assert sorted(got) == sorted(want) and len(want) > 40
    assert {(r.doc_id, r.kind) for r in found if r.doc_id in range(10, 30)} >= {(i, "near") for i in range(10, 30)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontamination.matches(none, spark.createDataFrame(items, "item_id long, text string"), slack=2).count() == 0
    assert decontamination.matches(edge.documents(spark), spark.createDataFrame([], "item_id long, text string"), slack=2).count() == 0
    assert decontamination.matches(edge.documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- licences ---

def brute_licenses(text, templates, least):
    """(start, words, license, dice) over every run of words that begins with a pair of the template, or as late as it can."""
    w, out = plain(text), []
    pairs = list(zip(w, w[1:]))
    for k, (name, t) in enumerate(templates.items()):
        v = plain(t)
        b, found = set(zip(v, v[1:])), []
        last = max(len(w) - len(v), 0)
        for s in sorted({min(i, last) for i, p in enumerate(pairs) if p in b}):
            a = set(pairs[s:s + len(v) - 1])
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= least:
                found.append((s, dice))
        for s, dice in found:
            if not any(abs(x - s) < len(v) and (y > dice or (y == dice and x < s)) for x, y in found):
                out.append((s, k, min(len(v), len(w)), name, round(dice, 9)))
    return [(s, n, name, dice) for s, _, n, name, dice in sorted(out)]


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License"); you may not use
# this file except in compliance with the License. You may obtain a copy of
# the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software distributed
# under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
# CONDITIONS OF ANY KIND, either express or implied. See the License for the
# specific language governing permissions and limitations under the License."""


@pytest.mark.parametrize("least", [0.8, 0.3])
def test_licenses(tables, spark, least):
    said = ["x\nLicensed under the Apache License, Version 2.0 (the work)\nAll rights reserved", "Released under the\nMIT License.",
            "all rights reserved " * 50, "The work was released under the MIT license by its authors, all rights are theirs.",
            "Released", "released under", f"import os\n{APACHE}\ncode " + "word " * 300]
    extra = [(900 + i, t, "en", "a", 1, "h", "k", "z") for i, t in enumerate(said)]
    docs = tables[0].select("doc_id", "text").unionByName(spark.createDataFrame(extra, edge.SCHEMA).select("doc_id", "text"))
    got = sorted(((r.doc_id, [(m.start, m.words, m.license, round(m.dice, 9)) for m in r.matches]) for r in licenses.scan(docs, least=least).collect()), key=str)
    want = sorted(((r.doc_id, list(brute_licenses(r.text, licenses.TEMPLATES, least))) for r in docs.collect()), key=str)
    assert got == want and any(m for _, m in got)


def test_real_notices_are_found_wherever_they_lie(spark):
    """Texts of licences, wrapped to other widths, behind comment signs, in the middle of a text or of a line, slightly changed."""
    import textwrap

    rows, wanted = [], {}
    for name in ("mit-text", "mit-warranty", "bsd-text", "isc-text", "gpl-notice", "apache-2.0-notice"):
        t = licenses.TEMPLATES[name]
        changed = t.replace("Software", "Library", 2).replace("without", "with no", 1)
        for form in (t, textwrap.fill(t, 40), "\n".join(f" * {x}" for x in textwrap.wrap(t, 60)), f"Some words first. {t} And more after it.",
                     "intro " * 200 + changed + " outro" * 200):
            wanted[len(rows)] = name
            rows.append((len(rows), form))
    rows.append((len(rows), "Permission to enter is hereby granted to all persons of the house. " * 20))
    found = {r.doc_id: {m.license for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(name in found[i] for i, name in wanted.items()) and not found[len(rows) - 1]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).where("size(matches) > 0").count() == 0


# --- classifier ---

def test_isotonic():
    y, w = np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.array([1.0, 1.0, 1.0, 3.0, 1.0])
    assert quality_classifier.isotonic(y, w).tolist() == [0.5, 0.5, 1.25, 1.25, 3.0]


def test_normal_equations_are_sums_over_rows(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50).astype(float)
    model = quality_classifier.Model(np.zeros(3), np.ones(3), rng.normal(size=(3, 4)), np.zeros(4), np.zeros(5), np.zeros(1), np.zeros(1))
    rows = spark.createDataFrame([(a.tolist(), b) for a, b in zip(x, y.tolist())], "x array<double>, y double").repartition(4)
    z = model.cosines(x)
    assert np.allclose(quality_classifier.normal_equations(rows, model), z.T @ np.column_stack([z, y]))


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality_classifier"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= s <= 1 for s, _, _ in held)
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc
    assert sum(p == q for _, p, q in held) / len(held) > 0.9


def test_edges_and_empty_tables(spark):
    docs, none = edge.documents(spark), edge.empty(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    inputs = quality_classifier.statistics(docs)
    got = quality_classifier.predict(inputs, quality_classifier.fit(inputs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = quality_classifier.statistics(none)
    model = quality_classifier.fit(nothing, labels)
    assert quality_classifier.predict(nothing, model).count() == 0
    assert {r.score for r in quality_classifier.predict(inputs, model).collect()} == {0.5}
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontamination.contamination(none, items).count() == 0
    clean = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r.n_hit for r in clean)
    assert licenses.scan(none).count() == 0 and licenses.scan(docs, {}).count() == docs.count()
