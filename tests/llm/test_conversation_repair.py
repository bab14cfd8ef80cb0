"""Conversation repair against a search through all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from hintwise.llm import conversation_repair as repair
from hintwise.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("piece", T.StringType()), T.StructField("h", T.LongType())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        elif kind == 2:
            x = re.sub("[.!?]", "", x)
        elif kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def search(rows):
    """The least (cost, audit, lines) over all edits that give roles of the grammar: best first, no merging but
    of what is equal. rows: (role, text, fault)."""
    def can_go_on(roles):
        return re.fullmatch("s?(ua)*u?", roles)

    heap, seen = [(0, "", "", 0, ())], set()
    while heap:
        cost, audit, roles, i, lines = heapq.heappop(heap)
        # what has been built matters by the part that decides what may follow
        state = (i, "end" if not roles else roles[-1])
        if state in seen:
            continue
        seen.add(state)
        if i == len(rows) + 1:
            return cost, audit, lines
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            heapq.heappush(heap, (cost, audit, roles, i + 1, lines))
        for t, name in (("u", "user"), ("a", "assistant")):
            if can_go_on(roles + t) and i <= len(rows):
                heapq.heappush(heap, (cost + 2, audit + "I", roles + t, i, lines + (f"{name}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", roles, i + 1, lines))
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                if role[:1] and can_go_on(roles + role[:1]):
                    heapq.heappush(heap, (cost, audit + "K", roles + role[:1], i + 1, lines + (f"{role}:{text}",)))
                for t, name in (("u", "user"), ("a", "assistant")):
                    if can_go_on(roles + t):
                        heapq.heappush(heap, (cost + 2, audit + "R", roles + t, i + 1, lines + (f"{name}:{text}",)))


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation, sorted."""
    seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        said = re.findall("[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            count[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = search(marked)
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made():
    """Conversations with every fault, odd roles, nulls and gaps, and one long one."""
    rng, rows = random.Random(9), []
    says = ["Yes.", "No", "", "  ", "What?", "Well!", None, "Yes.", "é ü.", "cut off"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "usher"]
    for c in range(120):
        turns = rng.sample(range(14), rng.randint(1, 9))
        for t in sorted(turns):
            rows.append((c, t, rng.choice(roles), rng.choice(says) if rng.random() < 0.5 else f"Line {rng.random()}."))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (500, None, "user", "x."), (501, None, "assistant", "y"), (501, 3, "user", "z.")]
    rows += [(600, t, rng.choice(roles[:4]), rng.choice(says) if rng.random() < 0.3 else f"Line {t}.") for t in range(900)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def grouped(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0])) for c, v in out.items()}


@pytest.mark.parametrize("piece_rows,partitions", [(2000, 8), (7, 8), (2000, 60)])
def test_against_search(spark, monkeypatch, piece_rows, partitions):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 10)
    try:
        rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in made()]
        rows += rows[:40] + [(600, None, "user", f"Line {t}.") for t in range(3)]  # copies at the same turn
        rows = [r for r in rows if r != (600, None, "user", "Line 1.")]
        fixed = repair.repair(table(spark, rows))
        got = {r.conv_id: (*(r[c] for c in COUNTS), r.repaired_sha256) for r in repair.digest(fixed).collect()}
        texts = {}
        for r in sorted(fixed.texts.collect(), key=lambda r: r.piece):
            texts.setdefault(r.first_piece, []).extend([] if r.text is None else [r.text])
        summary = fixed.summary.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = grouped(rows)
    # turns tie only between copies and within conversation 600, where the digest decides
    ties = [r for r in groups[600] if r[0] is None]
    ties.sort(key=lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    groups[600] = ties + [r for r in groups[600] if r[0] is not None]
    assert got == {c: brute_repair(g) for c, g in groups.items()}
    assert {r.conv_id: hashlib.sha256("\n".join(texts[r.first_piece]).encode()).hexdigest() for r in summary} == {c: v[-1] for c, v in got.items()}


@pytest.mark.parametrize("kind", ["made", "corpus"])
def test_query(spark, sf, tmp_path, kind):
    if kind == "made":
        table(spark, made()).write.parquet(f"{tmp_path}/conversations.parquet")
        sf = str(tmp_path)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = grouped(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: brute_repair(groups[c]) if c in groups else nothing for c in {r[0] for r in rows}}
    found = QUERIES["op12_conversation_repair"](spark, sf)
    assert found.columns == ["conv_id", *COUNTS, "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert got == want and found.count() == len(want)


def test_automaton():
    lr = repair.Automaton()
    def accepted(word):
        stacks = frozenset({(0,)})
        for t in word:
            stacks = lr.shift(stacks, t)
            if not stacks:
                return False
        return lr.accepts(stacks)
    words = [""]
    for _ in range(6):
        words += [w + t for w in words for t in "sua" if len(w) < 6]
    assert len(lr.starts) == 4
    assert all(accepted(w) == bool(re.fullmatch("(s?(ua)+)?", w)) for w in set(words))


def test_nothing(spark):
    fixed = repair.repair(spark.createDataFrame([], SCHEMA))
    assert repair.digest(fixed).count() == 0 and fixed.texts.count() == 0 and fixed.summary.count() == 0
