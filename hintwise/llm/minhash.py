"""Circulant MinHash: groups of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

Two permutations of the 32-bit numbers make every coordinate of a signature: the first scatters the
shingles, the second, shifted circularly by k places, gives coordinate k as its minimum. Texts that agree
in all eight coordinates of one of 64 bands are candidates, and whole shingle sets decide. A pair
of similarity s shares no band with probability (1 - s^8)^64: 8e-6 at 0.8, 1e-9 at 0.85.

The texts of a band are not paired with each other. All of them are compared with one of them first, which
joins a group of copies by as many comparisons as it has members. Bands that still hold texts of
different groups are cut into blocks of bounded size, and two blocks at a time meet in a task, which returns
no pairs but the few links that join groups. Every pair of a band is thus compared or already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import keyed, short_batches
from hintwise.llm.simhash import components
from hintwise.operators.scaling import written

SHINGLE_WORDS = 4
LEAST_PERCENT = 80
BANDS, BAND_ROWS = 64, 8
SEED = 42
# shingles that are permuted at once
CHUNK = 1024
# places that the second permutation is shifted from one coordinate to the next; odd, so that no two are alike
STEP = 0x9E3779B1
# shingles of a block of a band's texts
BLOCK_SHINGLES = 400_000


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted XXH64 hashes of the distinct runs of ``shingle_words`` words, A-Z lower-cased; a text
    of fewer words is one shingle, a text without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII rules for both
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle_words, len(found)) - 1:].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n))


def permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: exclusive-or shifts and odd factors, all of them invertible."""
    x = (x ^ x >> np.uint32(16)) * np.uint32(first)
    x = (x ^ x >> np.uint32(15)) * np.uint32(second)
    return x ^ x >> np.uint32(16)


def signature(found: np.ndarray, coordinates: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The least of the second permutation at each circular shift, over shingles that the first
    one has scattered."""
    scattered = permuted(found.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = (np.arange(coordinates, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]
    least = np.full(coordinates, (1 << 32) - 1, np.uint32)
    for at in range(0, len(scattered), CHUNK):
        places = scattered[at:at + CHUNK] - shifts
        np.minimum(least, permuted(places, 0x21F0AAAD, 0x735A2D97).min(axis=1), out=least)
    return least


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's number and its coordinates."""
    import xxhash

    rows = signature(found).reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, n_shingles, node, keys): a digest of each row's shingle set, and its band keys;
    both are null for an empty set."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("n_shingles bigint, node binary, keys array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            sets = [shingles(t, shingle_words) for t in texts]
            yield pd.DataFrame({
                "n_shingles": np.array([len(s) for s in sets], np.int64),
                "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [band_keys(s) if len(s) else None for s in sets]})

    return docs.select("doc_id", "_k1", "_k2", of("text").alias("s")).select("doc_id", "_k1", "_k2", "s.*")


def enough(shared: np.ndarray, a: int, b: np.ndarray, least_percent: int) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members, of which ``shared`` are common, are similar enough."""
    return 100 * shared >= least_percent * (a + b - shared)


def similar(pairs: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose shingle sets are similar enough."""
    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for s, t in zip(batch["s"], batch["t"]):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep.append(bool(enough(shared, len(x), len(y), least_percent)))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInPandas(verified, "a binary, b binary")


def block_links(nodes: list, roots: list, hashes: list, blocks: list, least_percent: int) -> list[tuple]:
    """Links that join the groups of a cell's texts: for each text outside of the cell's largest group one
    link to every group in which a text is similar enough. In a cell of two blocks only texts of
    different blocks are compared."""
    names, root = np.unique(np.array(roots, object), return_inverse=True)
    sides = len(set(blocks)) > 1
    side = np.array(blocks) != blocks[0]
    sizes = np.array([len(h) // 8 for h in hashes])
    codes = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for h in hashes]), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark, out = np.zeros(codes.max() + 1, np.int64), []
    joined = np.arange(len(names))
    for o in np.flatnonzero(root != np.bincount(root).argmax()):
        own = codes[starts[o]:ends[o]]
        mark[own] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        hit = enough(shared, sizes[o], sizes, least_percent) & (joined[root] != joined[root[o]])
        if sides:
            hit &= side != side[o]
        for x in np.flatnonzero(hit):
            if joined[root[x]] != joined[root[o]]:
                out.append((nodes[o], nodes[x]))
                joined[joined == joined[root[x]]] = joined[root[o]]
    return out


def rest_links(placed: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """(a, b): links between texts of a band (key, node, root) that belong to different groups.

    A band's texts are dealt to blocks by hash, so many that a block has about ``BLOCK_SHINGLES`` shingles,
    and each two blocks form a cell. Cells of a partition are read one after the other."""
    sized = placed.join(sets, "node")
    blocks = placed.join(sets.select("node", "n_shingles"), "node").groupBy("key").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = sized.join(blocks, "key").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "hashes")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, members = None, []

        def found() -> pd.DataFrame:
            return pd.DataFrame(block_links(*map(list, zip(*members)), least_percent) if len(members) > 1 else [],
                                columns=["a", "b"])

        for batch in batches:
            for key, i, j, *member in zip(*(batch[c] for c in ("key", "i", "j", "node", "root", "hashes", "block"))):
                if (key, i, j) != cell:
                    yield found()
                    cell, members = (key, i, j), []
                members.append(member)
        yield found()

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(linked, "a binary, b binary")


def grouped(shared: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """(node, root) of the nodes that have a link. ``shared`` (key, node, head) are the bands of two nodes
    and more, with one of the nodes."""
    pairs = written(shared.where("node != head").select(
        F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = written(similar(pairs, sets, least_percent), "similar")
    roots = written(components(links), "roots")
    # each node of a band has met its head; pairs of the others are open where their groups differ
    placed = shared.where("node != head").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    placed = written(placed.join(mixed, "key", "left_semi"), "mixed-bands")
    more = written(rest_links(placed, sets, least_percent), "more-links")
    return roots if more.isEmpty() else written(components(links.unionByName(more)), "roots")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked if the shared shingles are at least ``least_percent`` of all their shingles;
    component_id is the least doc_id that links reach, the document's own included, and kept says
    that it is its own. Equal sets are one node, so exact copies cost no more than one of them. A null
    or empty text, or one without words, has no shingle and no link. A null id counts as greater than all
    others: it is the component_id only of a group of null ids, where kept is true. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored. Very long texts are
    read whole, and may fill a block alone.
    """
    whole = keyed(docs.select("doc_id", "text"))
    marked = written(sketches(whole, shingle_words), "sketches")
    nodes = written(marked.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("_k1", "_k2")).alias("at"),
        F.first("keys").alias("keys")), "shingle-sets")
    bands = nodes.select(F.explode("keys").alias("key"), "node")
    heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where(
        "head != last").select("key", "head")
    shared = written(bands.join(heads, "key"), "bands")
    asked = shared.select("node").distinct().join(nodes, "node").select("node", "at._k1", "at._k2")

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle_words).tobytes() for t in texts])

    texts = whole.select("_k1", "_k2", "text").join(asked, ["_k1", "_k2"]).select("node", hashes("text").alias("hashes"))
    sets = written(texts.groupBy("node").agg(F.first("hashes").alias("hashes")).withColumn(
        "n_shingles", (F.octet_length("hashes") / 8).cast("bigint")), "sets")
    roots = grouped(shared, sets, least_percent)
    rooted = written(nodes.join(roots, "node", "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("node", "component_id")
    # empty sets share a null node, which never meets in one task
    out = marked.where("node IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", "component_id").unionByName(
        marked.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
