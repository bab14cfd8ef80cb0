"""Removal of passages that occur more than once, by super-k-mer partitioning.

A window is a run of so many words. Its minimiser is the least hash among its short word groups.
Neighbouring windows mostly share it, and such a run of windows (a super-k-mer) travels as one
packed string to the bucket of its minimiser. Equal windows have equal minimisers, so they meet in
one bucket, where sorting window hashes counts them and comparing their bytes makes it exact.

What a task has seen twice is settled in that task: one of several equal packed strings travels,
marked as repeated. So a bucket receives a string once per task at most, however many copies there
are, and no group of copies lands in one place.

A common phrase with a low hash is the minimiser of all windows around it, however different they are. A bucket
that grows beyond a number of bytes is therefore not gathered: its windows are dealt once more, each by a digest of
all its words, so equal windows still meet and different ones spread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintwise.llm.common import ABSENT, keyed, short_batches
from hintwise.operators.scaling import written

WINDOW_WORDS = 35
GROUP_WORDS = 4
# bytes of text that are turned into arrays at once, and bytes of packed strings held back
CHUNK_BYTES = 3 << 20
HELD_BYTES = 40 << 20
BUCKETS_PER_PARTITION = 8
# bytes of strings that a bucket gathers; beyond them its windows are dealt again
BUCKET_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_arrays(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts joined by line feeds, words by blanks; and
    the number of each word's text. No text may be empty."""
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    # a polynomial over the bytes of each word, modulo 2**64
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    power = np.full(int(place.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    terms = np.multiply.accumulate(power)[place]
    terms *= data.astype(np.uint64) + np.uint64(1)
    terms[gaps] = 0
    hashes = _mixed(np.add.reduceat(terms, starts))
    text = np.zeros(len(starts), np.int64)
    text[1:] = np.cumsum(data[gaps] == 10)
    return starts, ends, hashes, text


def _chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` items, by doubling."""
    a, have = np.uint64(0xD6E8FEB86659FD93), 1
    while have < length:
        step = min(have, length - have)
        hashes = _mixed(hashes[:-step] * a + hashes[step:]) if len(hashes) > step else hashes[:0]
        have += step
    return hashes


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def _windows(text: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie within one text."""
    n = len(text) - window + 1
    return np.flatnonzero(text[:n] == text[window - 1:]) if n > 0 else np.zeros(0, np.int64)


def super_kmers(texts: list[bytes], window: int, group: int):
    """For texts of blank-joined words: (text, first word, windows, minimiser, packed string)."""
    joined = b"\n".join(texts)
    starts, ends, hashes, text = word_arrays(joined)
    at = _windows(text, window)
    if not len(at):
        return
    least = _least(_mixed(_chained(hashes, group)), window - group + 1)[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (least[1:] != least[:-1]))))
    sizes = np.diff(np.append(first, len(at)))
    p = at[first]
    base = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
    yield from zip(
        text[p].tolist(), (p - base[text[p]]).tolist(), sizes.tolist(), least[first].tolist(),
        (joined[a:b] for a, b in zip(starts[p].tolist(), ends[p + sizes + window - 2].tolist())),
    )


PACKED = (
    "bucket int, packed binary, k1 array<bigint>, k2 array<bigint>, start array<int>, repeated array<boolean>, "
    "done_k1 array<bigint>, done_k2 array<bigint>, done_start array<int>, done_n array<int>"
)
RANGES = "_k1 bigint, _k2 bigint, start int, n int"
# a range that occurs elsewhere, or a window of a large bucket with its digest and whether its string is repeated
FOUND = RANGES + ", digest binary, twice boolean"


def _dealt(held: dict, buckets: int) -> pd.DataFrame:
    """Rows for the buckets: held maps a packed string to its minimiser and its occurrences."""
    import zstandard

    rows, done = defaultdict(lambda: ([], [], [], [], [])), ([], [], [], [])
    for packed, (least, places) in held.items():
        k1, k2, start, n = places[0]
        for column, value in zip(rows[least % buckets], (packed, k1, k2, start, len(places) > 1)):
            column.append(value)
        if len(places) > 1:
            for place in places:
                for column, value in zip(done, place):
                    column.append(value)
    compress = zstandard.ZstdCompressor(level=3).compress
    out = [(b, compress(b"\n".join(r[0])), *r[1:], [], [], [], []) for b, r in rows.items()]
    out.sort(key=lambda r: r[0])
    if done[0]:
        out[0] = (*out[0][:6], *done)
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pd.DataFrame(out, columns=names)


def packed_windows(docs: DataFrame, window: int, group: int, buckets: int) -> DataFrame:
    short_batches(docs.sparkSession)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0

        def cut(texts, keys):
            nonlocal size
            for t, start, n, least, packed in super_kmers(texts, window, group):
                entry = held.get(packed)
                if entry is None:
                    held[packed] = (least, [(*keys[t], start, n)])
                    size += len(packed) + 300
                else:
                    entry[1].append((*keys[t], start, n))
                    size += 100

        for batch in batches:
            texts, keys, chunk = [], [], 0
            for k1, k2, text in zip(batch["_k1"].tolist(), batch["_k2"].tolist(), batch["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                texts.append(b" ".join(words))
                keys.append((k1, k2))
                chunk += len(texts[-1])
                if chunk >= CHUNK_BYTES:
                    cut(texts, keys)
                    texts, keys, chunk = [], [], 0
                    if size >= HELD_BYTES:
                        yield _dealt(held, buckets)
                        held.clear()
                        size = 0
            if texts:
                cut(texts, keys)
        if held:
            yield _dealt(held, buckets)

    return keyed(docs.select("doc_id", "text")).select("_k1", "_k2", "text").mapInPandas(deal, PACKED)


def repeated_in_bucket(strings: list[bytes], repeated: list[bool], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the packed strings of a bucket: (string, word) of every window that occurs elsewhere."""
    joined = b"\n".join(strings)
    starts, ends, hashes, text = word_arrays(joined)
    at = _windows(text, window)
    values = _chained(hashes, window)[at]
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, len(ranked)))
    often = np.asarray(repeated, bool)[text[at]]
    again = np.maximum.reduceat(often[order].astype(np.int8), first) > 0 if len(first) else first
    hit = np.zeros(len(at), bool)
    hit[order[np.repeat((sizes > 1) | again, sizes)]] = True
    a, b = starts[at], ends[at + window - 1]
    for f, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = order[f:f + n]
        seen = [joined[x:y] for x, y in zip(a[members].tolist(), b[members].tolist())]
        if seen.count(seen[0]) != n:  # different words with one hash
            count = defaultdict(int)
            for s, m in zip(seen, members):
                count[s] += 1 + int(often[m])
            hit[members] = [count[s] > 1 for s in seen]
    base = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
    found = at[hit]
    return text[found], found - base[text[found]]


def _bucket_ranges(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    strings = [s for blob in rows["packed"] for s in expand(blob).split(b"\n")]
    k1, k2, start, repeated = (np.concatenate(list(rows[c])) for c in ("k1", "k2", "start", "repeated"))
    string, word = repeated_in_bucket(strings, repeated, window)
    open_ones = ~repeated[string].astype(bool)
    string, word = string[open_ones], word[open_ones]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(string) != 0) | (np.diff(word) != 1)))) if len(word) else np.zeros(0, int)
    n = np.diff(np.append(first, len(word)))
    s = string[first]
    done = [np.concatenate([np.asarray(x, np.int64) for x in rows[f"done_{c}"]]) for c in ("k1", "k2", "start", "n")]
    mine = (k1[s], k2[s], start[s] + word[first], n)
    return pd.DataFrame({
        c: np.concatenate((np.asarray(x, np.int64), y)).astype(t)
        for c, t, x, y in zip(("_k1", "_k2", "start", "n"), (np.int64, np.int64, np.int32, np.int32), mine, done)
    })


def _windows_again(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """The windows of a large bucket's strings, one by one, with digests of their words; and the ranges
    that are settled already."""
    import hashlib

    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    out: list[tuple] = []
    for blob, k1, k2, start, repeated, *done in zip(*(rows[c] for c in (
            "packed", "k1", "k2", "start", "repeated", "done_k1", "done_k2", "done_start", "done_n"))):
        joined = expand(blob)
        starts, ends, _, text = word_arrays(joined)
        at = _windows(text, window)
        base = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
        for p, t, a, b in zip(at.tolist(), text[at].tolist(), starts[at].tolist(), ends[at + window - 1].tolist()):
            digest = hashlib.blake2b(joined[a:b], digest_size=16).digest()
            out.append((k1[t], k2[t], start[t] + p - base[t], 1, digest, bool(repeated[t])))
        out += [(*d, None, None) for d in zip(*done)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def _read_buckets(window: int, most_bytes: int):
    """Reads rows that are sorted by bucket; holds no more than ``most_bytes`` of a bucket's strings."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        bucket, held, size = None, [], 0
        names = [c.split()[0] for c in PACKED.split(", ")]

        def settled() -> pd.DataFrame:
            return _bucket_ranges(pd.DataFrame(held, columns=names), window).assign(digest=None, twice=None)

        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                if row[0] != bucket:
                    if held:
                        yield settled()
                    bucket, held, size = row[0], [], 0
                size += zstandard.frame_content_size(row[1])
                held.append(row)
                if size > most_bytes:  # as for all further rows of the bucket
                    yield _windows_again(pd.DataFrame(held, columns=names), window)
                    held = []
        if held:
            yield settled()

    return read


def repeated_ranges(
    docs: DataFrame, window: int = WINDOW_WORDS, group: int = GROUP_WORDS, buckets: int | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(_k1, _k2, start, n): for a row's key, ``n`` windows from word ``start`` occur elsewhere."""
    if buckets is None:
        buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed_windows(docs, window, group, buckets).repartition("bucket").sortWithinPartitions("bucket")
    found = written(dealt.mapInPandas(_read_buckets(window, bucket_bytes), FOUND), "repeated-windows")
    ranges = ["_k1", "_k2", "start", "n"]
    large = found.where("digest IS NOT NULL")
    often = large.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max("twice").alias("_twice")).where("_n > 1 OR _twice")
    # the occurrences of a repeated string are settled where it was found
    again = large.where("NOT twice").join(often.select("digest"), "digest", "left_semi")
    return found.where("digest IS NULL").select(*ranges).unionByName(again.select(*ranges)).distinct()


def _without(text: str | None, starts, ns, window: int) -> tuple[list[bytes], list[bool]]:
    """The words of a text and whether each stays."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    stays = np.ones(len(found), bool)
    if starts is not None:
        for s, n in zip(starts, ns):
            stays[s:s + n + window - 1] = False
    return found, stays


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, group: int = GROUP_WORDS, buckets: int | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a repeated window
    covers, its other words joined by one blank; one row per input row.

    Windows are judged on the input. Null and short texts lose nothing; a null text keeps the empty
    text. Repeated rows repeat each other's windows, and all lose them. An empty table gives none.
    Other columns are ignored, whatever their names.
    """
    ranges = repeated_ranges(docs, window, group, buckets, bucket_bytes).groupBy("_k1", "_k2").agg(
        F.collect_list("start").alias("_starts"), F.collect_list("n").alias("_ns"))
    joined = keyed(docs.select("doc_id", "text")).join(ranges, ["_k1", "_k2"], "left")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, starts, ns in zip(batch["text"], batch["_starts"], batch["_ns"]):
                found, stays = _without(text, starts, ns, window)
                kept = found if stays.all() else [w for w, s in zip(found, stays.tolist()) if s]
                out.append((len(found), len(found) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            columns = list(zip(*out)) or [(), (), ()]
            yield pd.DataFrame({
                "_k1": batch["_k1"], "n_words": np.array(columns[0], np.int64),
                "n_removed": np.array(columns[1], np.int64), "kept": pd.Series(columns[2], dtype=object, index=batch.index),
            })

    cleaned = joined.select("_k1", "text", "_starts", "_ns").mapInPandas(
        clean, "_k1 bigint, n_words bigint, n_removed bigint, kept string")
    return cleaned.select(F.nullif("_k1", F.lit(ABSENT)).alias("doc_id"), "n_words", "n_removed", "kept")
