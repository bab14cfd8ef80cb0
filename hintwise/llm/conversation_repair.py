"""Conversation structure repair: the cheapest edits that bring the roles of a conversation into a grammar.

Generalised LR parsing with repairs: at every row a graph-structured stack shifts what is kept, reroled or
inserted, or lets the row go. Stacks with equal tops share their future and are merged, the least (cost,
audit) surviving.

Rows are dealt to tasks by ranges of (conversation, turn), so a conversation of any length is read by as many
tasks as it fills. Within a task it is cut into pieces. A piece is parsed from every stack top that it could
meet; what it costs to get from each top to each other one is all that is needed to put the pieces of a
conversation together, and then every piece writes its part of the repaired text on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hintwise.llm.common import BLANKS, per_process
from hintwise.operators.scaling import written

# a conversation: an optional system turn, then pairs of user and assistant; or nothing
GRAMMAR = (("S", ""), ("S", "C"), ("S", "sC"), ("C", "P"), ("C", "CP"), ("P", "ua"))
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
# most rows of a piece
PIECE_ROWS = 2000
FAULTS = ("blank", "duplicate", "truncated")


class Automaton:
    """LR(0) states of the grammar, with lookahead sets for reductions."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = (("^", grammar[0][0]), *grammar)
        self.heads = {h for h, _ in self.grammar}
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):
            for x in sorted({self.grammar[r][1][d] for r, d in state if d < len(self.grammar[r][1])}):
                to = self._closure({(r, d + 1) for r, d in state if self.grammar[r][1][d:d + 1] == x})
                if to not in self.states:
                    self.states.append(to)
                self.goto[i, x] = self.states.index(to)
        # stacks that stand for each top between two rows: whatever lies below a top, the same may follow
        self.shift = lru_cache(None)(self._shift)
        self.accepts = lru_cache(None)(self._accepts)
        self.starts, todo = {0: frozenset({(0,)})}, [frozenset({(0,)})]
        while todo:
            stacks = todo.pop()
            for t in "sua":
                if (to := self.shift(stacks, t)) and (top := top_of(to)) not in self.starts:
                    self.starts[top] = to
                    todo.append(to)

    def _closure(self, items):
        items, todo = set(items), list(items)
        while todo:
            r, d = todo.pop()
            nxt = self.grammar[r][1][d:d + 1]
            new = {(i, 0) for i, (h, _) in enumerate(self.grammar) if h == nxt} - items
            items |= new
            todo += new
        return frozenset(items)

    def _follow(self):
        first, empty, follow = {h: set() for h in self.heads}, set(), {h: set() for h in self.heads}
        follow["^"].add("$")
        for _ in range(2 * len(self.grammar)):
            for h, body in self.grammar:
                after, can_end = set(follow[h]), True
                for x in reversed(body):
                    if x in self.heads:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
                for x in body:
                    first[h] |= first[x] if x in self.heads else {x}
                    if x not in empty:
                        can_end = False
                        break
                if can_end:
                    empty.add(h)
        return follow

    def _reduced(self, stacks, lookahead):
        """All stacks that reductions before ``lookahead`` lead to, the given ones included."""
        seen, todo = set(stacks), list(stacks)
        while todo:
            stack = todo.pop()
            for r, d in self.states[stack[-1]]:
                head, body = self.grammar[r]
                if r and d == len(body) and lookahead in self.follow[head]:
                    below = stack[:len(stack) - d]
                    if (below[-1], head) in self.goto and (new := below + (self.goto[below[-1], head],)) not in seen:
                        seen.add(new)
                        todo.append(new)
        return seen

    def _shift(self, stacks, terminal):
        """The stacks after ``terminal``, all with one top; None if none can take it."""
        out = {s + (self.goto[s[-1], terminal],) for s in self._reduced(stacks, terminal) if (s[-1], terminal) in self.goto}
        return frozenset(out) or None

    def _accepts(self, stacks):
        return any((0, 1) in self.states[s[-1]] for s in self._reduced(stacks, "$"))


def top_of(stacks) -> int:
    return next(iter(stacks))[-1]


def automaton() -> Automaton:
    return per_process("role-grammar", Automaton)


def _inserted(lr: Automaton, tops: dict) -> dict:
    """Close the tops under insertions."""
    todo = list(tops)
    while todo:
        cost, audit, stacks = tops[todo.pop()]
        for t in NAMES:
            if to := lr.shift(stacks, t):
                new, top = (cost + INSERT, audit + "I", to), top_of(to)
                if top not in tops or new[:2] < tops[top][:2]:
                    tops[top] = new
                    todo.append(top)
    return tops


def parse(rows: list[tuple[str, int | None]], top: int = 0) -> dict[int, tuple[int, str, frozenset]]:
    """The cheapest (cost, audit, stacks) for every stack top after ``rows`` of (role initial, fault), if the
    stack has ``top`` before them. Insertions after the last row are left to what follows."""
    lr = automaton()
    tops = {top: (0, "", lr.starts[top])}
    for initial, fault in rows:
        after: dict = {}

        def offer(cost, audit, stacks):
            at = top_of(stacks)
            if at not in after or (cost, audit) < after[at][:2]:
                after[at] = (cost, audit, stacks)

        for cost, audit, stacks in _inserted(lr, tops).values():
            offer(cost + DELETE, audit + "D", stacks)
            if fault in (0, 1):
                continue
            cost += TRUNCATED if fault == 2 else 0
            for t in "sua":
                if to := lr.shift(stacks, t):
                    if t == initial:
                        offer(cost, audit + "K", to)
                    elif t in NAMES:
                        offer(cost + REROLE, audit + "R", to)
        tops = after
    return tops


def finish(tops: dict) -> tuple[int, str]:
    """The cheapest (cost, audit) of the tops that insertions may bring to an end of the grammar."""
    lr = automaton()
    return min((cost, audit) for cost, audit, stacks in _inserted(lr, dict(tops)).values() if lr.accepts(stacks))


def rewritten(rows: list[tuple[str, str]], audit: str, top: int = 0) -> list[str]:
    """``role:text`` of the rows that the edits keep, rerole or insert, from a stack with ``top``."""
    lr, out, i = automaton(), [], 0
    stacks = lr.starts[top]
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[i]
        i += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            stacks = lr.shift(stacks, role[:1])
        else:
            role, stacks = next((NAMES[t], to) for t in NAMES if (to := lr.shift(stacks, t)))
        out.append(f"{role}:{text}")
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the planted faults of the query: by the CRC-32 of ``conv_id:turn`` modulo 20 a row goes (0),
    loses its text (1) or the marks [.!?] in it (2), stands twice (3) or has the role user (4). Nulls are one
    space."""
    blank = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.coalesce("text", blank)
    return conversations.withColumn("_kind", kind).where("_kind != 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@dataclass(frozen=True)
class Repaired:
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and ``first_piece``.
    ``texts``: first_piece, piece, text: the repaired transcript, lines of ``role:text`` in pieces that are
    joined by newlines in their order; a piece without lines has a null text."""

    summary: DataFrame
    texts: DataFrame
    # the same by kind: conversations that one piece holds, with their text, and those of several with their parts
    whole: DataFrame
    split: DataFrame
    parts: DataFrame


def _piece_fields(conv: T.DataType) -> list[T.StructField]:
    long, text = T.LongType(), T.StringType()
    return [T.StructField("conv_id", conv), T.StructField("piece", long), *(T.StructField(c, long) for c in FAULTS),
            T.StructField("illegal", long), T.StructField("n_turns", long),
            *(T.StructField(c, long) for c in ("least", "most", "first_turn", "last_turn")),
            T.StructField("head", text), T.StructField("tail", text), T.StructField("more", T.BooleanType()),
            T.StructField("moves", T.ArrayType(T.StructType([
                T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()),
                T.StructField("cost", long), T.StructField("audit", text)]))),
            T.StructField("cost", long), T.StructField("audit", text), T.StructField("text", text),
            T.StructField("roles", T.ArrayType(text)), T.StructField("texts", T.ArrayType(text))]


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def fault_of(text: str, repeated: bool) -> int | None:
    said = text.strip(BLANKS)
    return 0 if not said else 1 if repeated else 2 if said[-1] not in ".!?" else None


def _described(conv, piece: int, rows: list[tuple], more: bool) -> dict:
    """What is known of a piece: ``rows`` are (turn, role, text, fault)."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    out = {"conv_id": conv, "piece": piece, "n_turns": len(set(turns)), "more": more,
           "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
           "least": min(turns, default=None), "most": max(turns, default=None),
           "first_turn": rows[0][0], "last_turn": rows[-1][0], "head": initials[0], "tail": initials[-1]}
    out |= {name: sum(r[3] == i for r in rows) for i, name in enumerate(FAULTS)}
    marks = [(i, r[3]) for i, r in zip(initials, rows)]
    if more:
        out["moves"] = [{"entry": t, "exit": to, "cost": cost, "audit": audit}
                        for t in automaton().starts for to, (cost, audit, _) in parse(marks, t).items()]
        out |= {"roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}
    else:
        out["cost"], out["audit"] = finish(parse(marks))
        lines = rewritten([r[1:3] for r in rows], out["audit"])
        out["text"] = "\n".join(lines) if lines else None
    return out


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations: those that lie within a task's range are repaired at once, those that a
    range's end or their length divides carry their costs between stack tops and their rows."""
    blank = F.lit(" ")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    full = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                       F.coalesce("text", blank).alias("text")).withColumn("h", digest)
    # rows that repeat an earlier one, but for copies at the same place, which their neighbours tell
    places = full.select("conv_id", "turn", "role", "h").groupBy("conv_id", "turn", "role", "h").agg(F.lit(True).alias("_"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = places.groupBy("conv_id", "h").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last")
    later = places.alias("p").join(firsts.alias("f"), F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.h") == F.col("f.h"))).where(
        F.struct(F.col("p.turn").isNotNull().alias("known"), F.col("p.turn").alias("turn")) > F.col("f.first")).select(
        "p.conv_id", "p.turn", "p.role", "p.h")
    both = full.withColumn("mark", F.lit(1)).unionByName(later.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    keys = ["conv_id", "turn", "role", "h"]
    schema = T.StructType(_piece_fields(full.schema["conv_id"].dataType))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        conv, held, started, split, marked, last, out = None, [], False, False, None, None, []

        def close(more: bool) -> None:
            nonlocal number, held
            if held:
                out.append(_described(conv, number, held, more))
                number, held = number + 1, []

        at_start = True
        for batch in batches:
            for c, turn, role, text, h, mark in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "h", "mark"))):
                if not started or c != conv:
                    if started:
                        close(split or at_start)
                        at_start = False
                    conv, started, split, marked, last = c, True, False, None, None
                place = (turn, role, h)
                if mark == 0:
                    marked = place
                    continue
                if len(held) >= PIECE_ROWS:
                    split = True
                    close(True)
                held.append((turn, role, text, fault_of(text, place in (marked, last))))
                last = place
            if out:
                yield _arrow(out, arrow)
                out.clear()
        close(True)  # the next range may go on with it
        if out:
            yield _arrow(out, arrow)

    return both.repartitionByRange(*keys).sortWithinPartitions(*keys, "mark").select(*keys, "text", "mark").mapInArrow(read, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation of several pieces, or of one at a range's end, with the way through them:
    entry top and edits of each piece."""
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([
        pieces.schema["conv_id"], T.StructField("first_piece", long), *(T.StructField(c, long) for c in ("gaps", *FAULTS, "illegal", "cost")),
        T.StructField("audit", text), T.StructField("way", T.ArrayType(T.StructType([
            T.StructField("piece", long), T.StructField("entry", T.IntegerType()), T.StructField("audit", text)])))])
    columns = [f.name for f in _piece_fields(T.LongType()) if f.name not in ("more", "cost", "audit", "text", "roles", "texts")]

    def chained(group: list[dict]) -> dict:
        lr, tops = automaton(), {0: (0, "", None)}
        for p in group:
            after: dict = {}
            for m in p["moves"]:
                if m["entry"] in tops:
                    cost, audit, way = tops[m["entry"]]
                    new = (cost + m["cost"], audit + m["audit"], (way, m["entry"], len(audit)))
                    if m["exit"] not in after or new[:2] < after[m["exit"]][:2]:
                        after[m["exit"]] = new
            tops = after
        ends = {t: finish({t: (c, x, lr.starts[t])}) for t, (c, x, _) in tops.items()}
        best = min(ends, key=ends.get)
        (cost, audit), link = ends[best], tops[best][2]
        way, end = [], len(audit)
        for p in reversed(group):
            link, entry, start = link
            way.append({"piece": p["piece"], "entry": entry, "audit": audit[start:end]})
            end = start
        known = [p for p in group if p["least"] is not None]
        n = sum(p["n_turns"] for p in group) - sum(
            a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(group, group[1:]))
        return {"conv_id": group[0]["conv_id"], "first_piece": group[0]["piece"], "cost": cost, "audit": audit, "way": way[::-1],
                "gaps": max(p["most"] for p in known) - min(p["least"] for p in known) + 1 - n if known else 0,
                "illegal": sum(p["illegal"] for p in group) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(group, group[1:])),
                **{f: sum(p[f] for p in group) for f in FAULTS}}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, group = to_arrow_schema(schema), []
        for batch in batches:
            for p in batch.to_pylist():
                if group and p["conv_id"] != group[0]["conv_id"]:
                    yield _arrow([chained(group)], arrow)
                    group = []
                group.append(p)
        if group:
            yield _arrow([chained(group)], arrow)

    return pieces.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(read, schema)


def repair(conversations: DataFrame) -> Repaired:
    """Repair every conversation of (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and a digest of role and text. The first fault of a
    row counts: blank (no character but ASCII white space), duplicate (role and text seen earlier),
    truncated (the last such character is none of [.!?]). Keeping a row costs nothing, a new role (user or
    assistant) 2, deleting 3, inserting an empty user or assistant turn anywhere 2; a truncated row that stays adds
    1, and blank and duplicate rows have to go. Roles count by their first character. ``audit`` has the initials of
    the cheapest edits in order, of equally cheap ones the least in ASCII order. ``gaps`` are the turns missing between the
    least and the greatest; ``illegal`` counts neighbours before repair whose initials are not su, ua or au.

    A null role or text is one space; a null conv_id is a conversation of its own; turns that are all null have no gaps.
    Repeated rows are duplicates. Other columns are ignored. An empty table gives no rows. A conversation may have any
    number of rows: a piece holds at most ``PIECE_ROWS``, with their whole texts.
    """
    pieces = written(_pieces(conversations), "conversation-pieces")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    names = ["conv_id", "first_piece", "gaps", *FAULTS, "illegal", "cost", "audit"]
    whole = pieces.where("NOT more").withColumn("gaps", gaps).withColumn("first_piece", F.col("piece"))
    split = written(_joined(pieces.where("more")), "conversation-ways")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first_piece", "piece", "entry", "audit", "roles", "texts")
        for batch in batches:
            for first, piece, entry, audit, roles, texts in zip(*(batch.column(n).to_pylist() for n in names)):
                lines = rewritten(list(zip(roles, texts)), audit, entry)
                yield pa.RecordBatch.from_pydict({"first_piece": pa.array([first], pa.int64()), "piece": pa.array([piece], pa.int64()),
                                                  "text": pa.array(["\n".join(lines) if lines else None], pa.string())})

    ways = split.select("first_piece", F.inline("way"))
    parts = pieces.where("more").select("piece", "roles", "texts").join(ways, "piece").mapInArrow(
        write, "first_piece bigint, piece bigint, text string")
    texts = whole.select("first_piece", "piece", "text").unionByName(parts)
    return Repaired(whole.select(*names).unionByName(split.select(*names)), texts, whole.select(*names, "text"), split.select(*names), parts)


def digest(repaired: Repaired) -> DataFrame:
    """The summary with ``repaired_sha256``, the digest of the whole repaired text. The pieces of a divided
    conversation are read in order, one at a time."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "first_piece": pa.array([first], pa.int64()), "repaired_sha256": pa.array([sha.hexdigest()], pa.string())})

        first = sha = None
        for batch in batches:
            for key, text in zip(batch.column("first_piece").to_pylist(), batch.column("text").to_pylist()):
                if key != first:
                    if first is not None:
                        yield done()
                    first, sha, lines = key, hashlib.sha256(), False
                if text is not None:
                    sha.update((("\n" if lines else "") + text).encode("utf-8", "surrogatepass"))
                    lines = True
        if first is not None:
            yield done()

    sums = repaired.parts.repartition("first_piece").sortWithinPartitions("first_piece", "piece").mapInArrow(
        read, "first_piece bigint, repaired_sha256 string")
    whole = repaired.whole.withColumn("repaired_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    return whole.unionByName(repaired.split.join(sums, "first_piece")).drop("first_piece")
