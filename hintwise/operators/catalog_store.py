"""A catalog that changes while it is served.

Document frequencies add up: a table (token, df) with the number of entries beside it, plus what was added,
minus what was dropped, is that of the new catalog. A :class:`CatalogStore` keeps versions of a catalog in a
shared folder, each with its entries, frequencies, vocabulary and packed blocks. A version counts from the moment its
last file, the description, has been written; versions are never changed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hintwise.functions.text import word_tokens
from hintwise.operators.blocks import PackedCatalog
from hintwise.operators.ranking import TextCatalog, fit_catalog
from hintwise.operators.scaling import dense_positions, scratch, written

# stands for "any entry" among the words, and counts every entry once; no word is empty
ENTRY = ""


def document_frequencies(entries: DataFrame, text: str = "doc", sign: int = 1) -> DataFrame:
    """``(token, df)``: in how many entries each word occurs; the entries themselves are counted under
    ``ENTRY``. With a ``sign`` of -1, what dropping the entries takes away."""
    words = F.concat(F.array(F.lit(ENTRY)), F.coalesce(F.array_distinct(word_tokens(F.col(text))), F.array().cast("array<string>")))
    return entries.select(F.explode(words).alias("token")).groupBy("token").agg((F.count(F.lit(1)) * sign).alias("df"))


def changed_frequencies(frequencies: DataFrame, *changes: DataFrame) -> DataFrame:
    """The sum of frequency tables; words that no entry holds any more are gone."""
    total = frequencies
    for change in changes:
        total = total.unionByName(change)
    return total.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def inverse_frequencies(frequencies: DataFrame) -> DataFrame:
    """``(token, df, idf)`` as from ``token_document_frequency``."""
    entries = frequencies.where(F.col("token") == ENTRY).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar()
    return frequencies.where(F.col("token") != ENTRY).withColumn("idf", F.log((entries + 1) / (F.col("df") + 1)) + 1)


@dataclass(frozen=True)
class CatalogStore:
    """Versions of a catalog ``(table, doc)`` below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str

    def _file(self, version: int, name: str) -> str:
        return f"{self.path.rstrip('/')}/version={version}/{name}"

    def _paths(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in their order."""
        files, root = self._paths(self.path)
        if not files.exists(root):
            return []
        numbers = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(root)
                   if s.getPath().getName().startswith("version=")]
        return sorted(n for n in numbers if self._complete(n))

    def _complete(self, version: int) -> bool:
        files, path = self._paths(self._file(version, "description/_SUCCESS"))
        return files.exists(path)

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def _next(self) -> int:
        files, root = self._paths(self.path)
        begun = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(root)
                 if s.getPath().getName().startswith("version=")] if files.exists(root) else []
        return max(begun, default=-1) + 1

    def _read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._file(version, name))

    def publish(self, entries: DataFrame, frequencies: DataFrame | None = None) -> int:
        """Write a new version of all ``entries(table, doc)``, names being unique, and return its number. A version
        that another writer began meanwhile, or that was broken off, keeps its number."""
        version = self._next()
        with scratch(self.spark):
            entries.select("table", "doc").write.parquet(self._file(version, "entries"))
            stored = self._read(version, "entries")
            counted = document_frequencies(stored) if frequencies is None else frequencies
            counted.write.parquet(self._file(version, "frequencies"))
            vocabulary = dense_positions(inverse_frequencies(self._read(version, "frequencies")), "token", "term")
            vocabulary.write.parquet(self._file(version, "vocabulary"))
            ready = fit_catalog(stored, self._read(version, "vocabulary"))
            packed = ready.packed
            packed.blocks.write.parquet(self._file(version, "blocks"))
            about = {"small": ready.small, "rows": packed.rows, "values": packed.values, "single": packed.single}
            self.spark.createDataFrame([(json.dumps(about),)], "about string").write.parquet(self._file(version, "description"))
        return version

    def change(self, added: DataFrame | None = None, dropped: DataFrame | None = None) -> int:
        """A new version: the last one without the tables of ``dropped(table)``, and with ``added(table, doc)``,
        which replace entries of the same names. Frequencies change by the words of these entries only."""
        last = self.latest()
        if last is None:
            raise ValueError(f"no complete version below {self.path}")
        held = self._read(last, "entries")
        with scratch(self.spark):
            new = written((held.limit(0) if added is None else added).select("table", "doc"), "added-entries")
            names = new.select("table")
            gone = written(held.join((names if dropped is None else names.unionByName(dropped.select("table"))).distinct(),
                                     "table", "left_semi"), "dropped-entries")
            kept = held.join(gone.select("table"), "table", "left_anti")
            frequencies = changed_frequencies(self._read(last, "frequencies"), document_frequencies(new), document_frequencies(gone, sign=-1))
            return self.publish(kept.unionByName(new), frequencies)

    def load(self, version: int) -> TextCatalog:
        """A complete version, ready to be ranked."""
        about = json.loads(self._read(version, "description").first().about)
        blocks = self._read(version, "blocks")
        name_type = blocks.schema["c_ids"].dataType.elementType
        packed = PackedCatalog(blocks, "table", name_type, about["rows"], about["values"], about["single"], True)
        return TextCatalog(self._read(version, "vocabulary"), about["small"], packed)
