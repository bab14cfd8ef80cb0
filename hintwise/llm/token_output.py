"""Token ids as compressed bit planes.

Documents are range-partitioned by id, tokenized, and cut into chunks of so many ids. A chunk's
32-bit ids are transposed: plane k holds byte k (or bit k) of every id, so the high planes are
nearly constant and compress to almost nothing. Each plane is compressed with zstandard on its
own. A chunk is one binary record; records and their index are columns of Parquet files, because
only Spark's writers reach every store and leave no half-written file when an executor is lost.

Record: magic ``HWBP``, version 1, plane width in bits (1 or 8), number of planes, a zero byte,
number of ids and then the byte length of each compressed plane as little-endian 32-bit numbers,
then the planes, lowest first. Index: shard, chunk, first id of the chunk within the shard, number
of ids, and for each document (or part of one) in it: number within the shard, id, ids of it before
this chunk, ids of it here, and whether it ends here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hintwise.llm.common import per_process, short_batches, text_hash
from hintwise.operators.scaling import shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CHUNK_IDS = 1 << 16
LEVEL = 3
MAGIC = b"HWBP"
# distinct words whose ids a worker remembers; beyond them words are tokenized again each time
REMEMBERED = 200_000
CHUNK_SCHEMA = (
    "shard int, chunk int, first_id bigint, n_ids int, record binary, doc_no array<bigint>, "
    "doc_id array<bigint>, doc_before array<bigint>, doc_ids array<int>, doc_ends array<boolean>"
)


# --- planes -----------------------------------------------------------------------------------

def planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Bit (width 1) or byte (width 8) planes of 32-bit ids, lowest first, up to the highest that
    is not all zero."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        out = [np.ascontiguousarray(data[:, k]).tobytes() for k in range(4)]
    else:
        bits = np.unpackbits(data, axis=1, bitorder="little")
        out = [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]
    while out and not out[-1].strip(b"\0"):
        out.pop()
    return out


def from_planes(parts: list[bytes], n: int, width: int) -> np.ndarray:
    """The inverse of ``planes``."""
    if width == 8:
        data = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            data[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(parts):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
        data = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(data).view("<u4").reshape(-1)


def encode_chunk(ids: np.ndarray, width: int = 8, level: int = LEVEL) -> bytes:
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    parts = [compress(p) for p in planes(ids, width)]
    head = MAGIC + bytes((1, width, len(parts), 0))
    return head + struct.pack(f"<{1 + len(parts)}I", len(ids), *map(len, parts)) + b"".join(parts)


def decode_chunk(record: bytes) -> np.ndarray:
    import zstandard

    if record[:4] != MAGIC or record[4] != 1:
        raise ValueError("not a chunk of token ids")
    width, count = record[5], record[6]
    n, *sizes = struct.unpack_from(f"<{1 + count}I", record, 8)
    expand, at, parts = zstandard.ZstdDecompressor().decompress, 12 + 4 * count, []
    for size in sizes:
        parts.append(expand(record[at:at + size], max_output_size=n + 8))
        at += size
    return from_planes(parts, n, width)


# --- tokens -----------------------------------------------------------------------------------

class WordEncoder(dict):
    """Ids (as little-endian bytes) of words between white space, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words one after the other. A word of letters, with or without marks after it, goes straight to
    the vocabulary's merges; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in plain]
        self.byte_names = {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(rest)}}

    def _run(self, run: str) -> bytes:
        found = self.letters.get(run)
        if found is None:
            named = run if run.isascii() else run.encode().decode("latin-1").translate(self.byte_names)
            found = np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()
            if len(self.letters) < REMEMBERED:
                self.letters[run] = found
        return found

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(".,;:!?*#$%&|")
        # up to U+024F letters are composed (NFC) and lower-case one by one
        if body.isalpha() and max(body) < "ɐ" and "İ" not in body:
            found = self._run(body.lower())
            if len(body) < len(word):
                found += self._run(word[len(body):])
        else:
            found = self._whole(word)
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def _encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return per_process(f"words:{path}", lambda: WordEncoder(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- files ------------------------------------------------------------------------------------

def ordered(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, doc_id, text) in ascending order of id over the shards and within each; null ids
    first, rows of one id by a hash of the text. Rows that repeat both are spread by a third key, so
    no id, however frequent, has to fit one shard."""
    keys = docs.select(
        "doc_id", "text", text_hash(F.col("text")).alias("_h"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).alias("_spread"),
    )
    dealt = keys.repartitionByRange(shards, "doc_id", "_h", "_spread").sortWithinPartitions("doc_id", "_h", "_spread")
    return dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")


def encode(
    docs: DataFrame, path: str, shards: int | None = None, end_id: int = END_ID,
    chunk_ids: int = CHUNK_IDS, width: int = 8,
) -> DataFrame:
    """Chunks of token ids in ascending id order, with their index (``CHUNK_SCHEMA``).

    Every text is encoded whole and followed by ``end_id``; a null or empty text has that id only.
    """
    if shards is None:
        shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    short_batches(docs.sparkSession)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        end = struct.pack("<I", end_id)
        held, parts, size, shard, chunk, first, doc_no = [], [], 0, 0, 0, 0, -1

        def row(count: int):
            nonlocal held, parts, size, chunk, first
            data = b"".join(held)
            ids, rest = np.frombuffer(data[:4 * count], "<u4"), data[4 * count:]
            columns = [list(c) for c in zip(*parts)] or [[] for _ in range(5)]
            out = (shard, chunk, first, count, encode_chunk(ids, width), *columns)
            held, size, parts = [rest] if rest else [], len(rest) // 4, []
            chunk, first = chunk + 1, first + count
            return out

        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            known = batch["known"].to_numpy(bool)
            for s, i, k, text in zip(batch["shard"], batch["id"].tolist(), known, batch["text"]):
                shard, doc_no = s, doc_no + 1
                data = (encoder.encode(text) if text else b"") + end
                left, before = len(data) // 4, 0
                held.append(data)
                size += left
                while left:
                    here = min(left, chunk_ids - (size - left))
                    left -= here
                    parts.append((doc_no, i if k else None, before, here, left == 0))
                    before += here
                    if size >= chunk_ids:
                        rows.append(row(chunk_ids))
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if size:
            yield pd.DataFrame([row(size)], columns=names)

    rows = ordered(docs, shards).select(
        "shard", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return rows.mapInPandas(chunks, CHUNK_SCHEMA)


def write(docs: DataFrame, folder: str, path: str, **options) -> None:
    """Write the chunks to a folder of any store that Spark reaches."""
    encode(docs, path, **options).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: (shard, doc_no, doc_id, start, n_tokens, ids), ids as
    little-endian 32-bit numbers; start counts all ids before the document."""
    return _documents(spark, folder, whole=True)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``read``, but with the ids' unsigned crc32 in place of the ids. A document that lies in
    one chunk is digested where the chunk is decoded; only parts of others travel."""
    return _documents(spark, folder, whole=False)


def _documents(spark: SparkSession, folder: str, whole: bool) -> DataFrame:
    chunks = spark.read.parquet(folder)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                data, at = decode_chunk(r.record).tobytes(), 0
                for no, i, before, n, ends in zip(r.doc_no, r.doc_id, r.doc_before, r.doc_ids, r.doc_ends):
                    piece = data[4 * at:4 * (at + n)]
                    digest = zlib.crc32(piece) if not whole and ends and not before else None
                    out.append((r.shard, no, None if i is None or i != i else int(i), int(before), r.first_id + at if not before else None, int(n), piece if digest is None else None, digest))
                    at += n
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype(
                {"doc_id": "Int64", "first": "Int64", "crc": "Int64"})

    pieces = chunks.mapInPandas(documents, PIECES)
    rows = pieces.groupBy("shard", "doc_no").agg(
        F.max("doc_id").alias("doc_id"), F.max("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.max("crc").alias("crc"),
        F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("before", "ids")))).alias("parts"),
    )
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    joined = rows.join(F.broadcast(bases), "shard")  # one row per shard
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    value = ids.alias("ids") if whole else F.coalesce("crc", F.crc32(ids)).alias("ids_crc32")
    return joined.select("shard", "doc_no", "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", value)


PIECES = (
    "shard int, doc_no bigint, doc_id bigint, before bigint, first bigint, n int, ids binary, crc bigint"
)


def encoded_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to the shared folder and read (doc_id, start, n_tokens, ids_crc32) back from
    the files, one row per input row.

    Null ids come first; rows with one id follow in the order of a hash of their texts; a null text
    is encoded like an empty one. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-chunks")
    write(docs, folder, path or tokenizer_path(), **options)
    return read_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
