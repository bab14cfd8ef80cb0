"""SimHash near-duplicates, found through Golay codes.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The binary Golay code is
perfect: every 23-bit word lies within 3 bits of exactly one codeword. Two words that differ in
one bit or none have the nearest codeword of either within 4 bits of the other. Of three segments
that share at most three errors, two have at most one each (pigeonhole). So each fingerprint is
stored under the nearest codewords of every two segments, and looked up under all codewords within
4 bits of them: one per segment, or six where the nearest is 3 bits away. Bit counts verify what
the keys bring together, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import hand_back, keyed, per_process, short_batches
from hintwise.operators.scaling import written

GENERATOR = 0b110001110101  # the Golay code's generator polynomial
WORD_BITS, CHECK_BITS = 23, 11
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
MOST_BITS = 3
SHINGLE_WORDS = 3
SEED = 42


# --- fingerprints -----------------------------------------------------------------------------

def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes; no words give 0."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII rules for both
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle_words, len(found)) - 1:].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = n - n % 255  # sums of 255 rows fit a byte
    votes = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        votes += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, more: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *more, fp), one row per input row; fp is the fingerprint as a signed number."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))
        hand_back()

    return docs.select("doc_id", *more, of("text").alias("fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- Golay keys -------------------------------------------------------------------------------

def syndrome(word: int) -> int:
    """Remainder of a word by the generator polynomial."""
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less, and the five of weight 4 that go with an error
    of weight 3 (its own otherwise). XORed to a word they give the codewords nearby."""
    return per_process("golay", _error_patterns)


def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    single = [syndrome(1 << i) for i in range(WORD_BITS)]
    near, far = np.zeros(1 << CHECK_BITS, np.int64), [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(1, 5):
        for places in combinations(range(WORD_BITS), weight):
            s, word = 0, 0
            for p in places:
                s, word = s ^ single[p], word | 1 << p
            if weight < 4:
                near[s] = word
            else:
                far[s].append(word)
    return near, np.array([f if len(f) == 5 else [near[s]] * 5 for s, f in enumerate(far)], np.int64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i in range(WORD_BITS):
        out ^= np.where(words >> i & 1, syndrome(1 << i), 0)
    return out


def codewords(fp: np.ndarray, segment: int) -> np.ndarray:
    """Indices (12 bits) of the codewords near one segment of fingerprints: the nearest in column
    0, those at distance 4 in columns 1 to 5, or the nearest again where there are none."""
    low, bits = SEGMENTS[segment]
    words = (fp.view(np.uint64) >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
    s = _syndromes(words)
    near, far = error_patterns()
    return np.column_stack([words ^ near[s], words[:, None] ^ far[s]]) >> CHECK_BITS


PAIRS = tuple(combinations(range(len(SEGMENTS)), 2))


def golay_keys(fps: DataFrame, probe: bool) -> DataFrame:
    """(key, fp): three keys for a stored fingerprint, up to 108 for one that is looked up."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy(np.int64)[first:first + 4096]
                near = [codewords(fp, s) for s in range(len(SEGMENTS))]
                for k, (a, b) in enumerate(PAIRS):
                    left, right = (near[x] if probe else near[x][:, :1] for x in (a, b))
                    both = (left[:, :, None] << 12 | right[:, None, :]).reshape(len(fp), -1) | k << 24
                    both.sort(axis=1)
                    fresh = np.ones(both.shape, bool)
                    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
                    yield pd.DataFrame({
                        "key": both[fresh].astype(np.int32), "fp": np.repeat(fp, fresh.sum(axis=1)),
                    })
        hand_back()

    return fps.select("fp").mapInPandas(keys, "key int, fp bigint")


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most three bits."""
    if most_bits > MOST_BITS:
        raise ValueError("the keys find differences of up to three bits")
    stored = golay_keys(fps, probe=False).withColumnRenamed("fp", "b")
    asked = golay_keys(fps, probe=True).withColumnRenamed("fp", "a")
    near = (stored["key"] == asked["key"]) & (F.col("a") != F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    return asked.join(stored, near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


# --- components -------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component for every node that has a link.

    Large-star and small-star steps in turn: each links a node's neighbours to the least of them,
    so components become stars in a logarithmic number of rounds. Every round is written to the
    shared folder; only counts come to the driver.
    """
    def star(both: DataFrame, keep: Column) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        return both.join(least, "u").where(keep)

    def summary(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    before = summary(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large, F.lit(True)).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.*").where("u != v").distinct()
        e = written(small, "links")
        after = summary(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _grouped(marked: DataFrame, most_bits: int) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``marked`` (doc_id, fp, ...)."""
    groups = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-groups")
    roots = components(links(groups, most_bits)).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row; component_id is the least doc_id among
    the documents that can be reached through links, the document's own included.

    Exact copies share a fingerprint and are combined before any join, so a group of copies costs
    no more than one of them. Null texts and texts without words have fingerprint 0, which links
    like any other. Null ids are ignored for the least id, and a group of null ids only has a null
    one. Repeated rows give repeated results; an empty table gives none. Other columns are ignored.
    """
    marked = written(fingerprints(docs, shingle_words), "fingerprints")
    found = _grouped(marked, most_bits).select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the least id
    stays (a null id counts as the greatest). Of rows that repeat an id and a text one stays."""
    whole = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text"))
    marked = written(fingerprints(whole, shingle_words, ("_k1", "_k2")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "_k1", "_k2")
    best = marked.groupBy("fp").agg(F.min(order).alias("first"))
    first = best.join(_grouped(marked, most_bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
    repeats = marked.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    stay = written(first.select("first._k1", "first._k2").join(repeats, ["_k1", "_k2"]), "survivors")
    keys = ["_k1", "_k2"]
    single = whole.join(stay.where("n = 1"), keys, "left_semi").select("_row.*")
    if stay.where("n > 1").isEmpty():
        return single
    return single.unionByName(whole.join(stay.where("n > 1"), keys, "left_semi").dropDuplicates(keys).select("_row.*"))
