"""Secret scans: fixed patterns, plus a likelihood ratio of two character Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import let, running_sums

# kind, pattern, least characters of the value; the value is group 2 for assignments
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs of one class: a least length in the pattern finds what filtering by length leaves
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_LEAST = 8
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# weight of the even distribution in the model of random strings
EVEN_SHARE = 0.5
# least sum of log-likelihood ratios (nats) of a token
MARGIN = 12.0
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def matches(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, kind, end) in code points.

    Splitting at a pattern and extracting it walk the text alike, so a match starts after all
    pieces up to it and all matches before it.
    """
    def spans(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        value = found if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return let(F.split(t, pattern, -1), lambda pieces: let(found, lambda m: let(value, lambda v: let(
            running_sums(F.transform(pieces, F.char_length)), lambda before: let(
                running_sums(F.transform(m, F.char_length)), lambda upto: F.filter(
                    F.transform(m, lambda x, i: F.when(F.char_length(v[i]) >= least, F.struct(
                        (before[i] + upto[i] - F.char_length(x)).alias("start"), F.lit(kind).alias("kind"),
                        (before[i] + upto[i]).alias("end"),
                    ))), lambda x: x.isNotNull(),
                ),
            ),
        ))))

    return F.when(text.rlike(pattern), spans(text).cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start, then kind."""
    return F.sort_array(F.concat(
        matches(text, ASSIGN, 0, ASSIGN_LEAST, 2), matches(text, ACCESS, 1), matches(text, HEX, 2)
    ))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(sample, random): values of assignments, access keys and hex runs of all documents as random
    strings, and their runs of twelve or more letters or underscores as ordinary identifiers."""
    text = F.coalesce("text", F.lit(""))
    secrets = F.concat(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z_]{12,}"), F.lit(0))
    pairs = F.concat(
        F.transform(secrets, lambda s: F.struct(s.alias("sample"), F.lit(True).alias("random"))),
        F.transform(words, lambda s: F.struct(s.alias("sample"), F.lit(False).alias("random"))),
    )
    return docs.select(F.inline(pairs)).where(F.char_length("sample") >= ASSIGN_LEAST)


def fit_ratio(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random against ordinary.

    ``samples`` has (sample, random). The model of random strings mixes the shares of pairs with the
    even distribution (``EVEN_SHARE``), so that it does not depend on which kinds of secrets the samples
    happen to hold. That of ordinary identifiers joins each pair's share with the share of its second
    character (add-one smoothed), which weighs as much as ``len(ALPHABET)`` pairs. Pairs with a
    character outside the alphabet are skipped. The result has one number per pair of the alphabet's
    characters, row by row, so at most that many counts come to the driver. Without samples of one of
    the classes all ratios are 0.
    """
    pairs = samples.select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length("sample") - 1, F.lit(1))),
        lambda i: F.substring("sample", i, F.lit(2)),
    )).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = len(ALPHABET)
    random, plain = ([[counts.get((k, a + b), 0) for b in ALPHABET] for a in ALPHABET] for k in (True, False))
    if not any(map(any, random)) or not any(map(any, plain)):
        return [0.0] * size ** 2
    alone = [sum(column) + 1 for column in zip(*plain)]
    ratios = []
    for r, q in zip(random, plain):
        for b in range(size):
            even = EVEN_SHARE / size + (1 - EVEN_SHARE) * (r[b] / sum(r) if any(r) else 1 / size)
            ratios.append(math.log(even / ((q[b] + size * alone[b] / sum(alone)) / (sum(q) + size))))
    return ratios


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the pair ratios over a token of the alphabet's characters."""
    table = F.array(*map(F.lit, ratios))
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(place, lambda p: F.aggregate(
        F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(
            F.get(table, p[i - 1] * len(ALPHABET) + p[i]), F.lit(0.0))
    ))


def markov_spans(text: Column, ratios: list[float], base: Column, margin: float = MARGIN) -> Column:
    """Tokens of 16 or more characters that look random and touch no base span."""
    return F.filter(matches(text, TOKEN, 3), lambda s: (
        ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    ) & (log_ratio(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), ratios) >= margin))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], margin: float = MARGIN) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and spans (those and the models'), per row.

    Spans are (start, kind, end) by start, kind being a position in ``KINDS``; offsets count code
    points, the end is exclusive. A null or empty text has none. Repeated rows give repeated
    results; other columns are ignored. No shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", let(text, lambda t: let(base_spans(t), lambda b: F.struct(
        b.alias("base"), F.sort_array(F.concat(b, markov_spans(t, ratios, b, margin))).alias("spans")
    ))).alias("_s"))
    return found.select("doc_id", "_s.base", "_s.spans")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
