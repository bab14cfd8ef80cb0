"""Filter interaction audit against applying the filters one by one."""

import re
from itertools import permutations

import brute
import edge
import pytest

from hintwise.llm import filter_audit


def failed(text, doc_id, first_ids):
    text = text or ""
    w = brute.words(text)
    first = first_ids.get(text)
    return "".join(f for f, c in zip("ABCDE", (
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), doc_id is not None and first is not None and doc_id > first)) if c)


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first_ids, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first_ids[t or ""] = min(i, first_ids.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, s in rows:
        parts.setdefault(s or "", []).append((i, failed(t, i, first_ids)))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (
                    len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == f for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


@pytest.mark.parametrize("kind", ["edge", "corpus"])
def test_against_brute_force(spark, sf, kind):
    if kind == "edge":
        docs = edge.documents(spark)
        labels = spark.createDataFrame(
            [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 140, 3)] + [(5, 1, 1, "x"), (5, 0, 0, "x"), (None, 1, 1, "x"), (6, None, None, "x")],
            "doc_id long, quality int, toxic int, source string")
    else:
        docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = brute_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()],
                       [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(docs, labels).collect()}
    assert got == want


def test_intervals_cover_every_order_once():
    orders = list(permutations("ABCDE"))
    assert [filter_audit.rank("".join(o)) for o in orders] == list(range(120))
    caught = {}
    for mask, step, first, after in filter_audit.intervals():
        for r in range(first, after):
            assert (mask, r) not in caught
            caught[mask, r] = step
    assert caught == {(mask, r): next(k + 1 for k, f in enumerate(o) if mask >> "ABCDE".index(f) & 1)
                      for mask in range(1, 32) for r, o in enumerate(orders)}


def test_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(edge.empty(spark), labels).count() == 0
    assert filter_audit.audit(edge.documents(spark), labels).count() == 600 * 4
