"""Analysis of questions as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hintwise.operators.catalog_store import CatalogStore
from hintwise.operators.ranking import TextCatalog, fit_catalog
from hintwise.operators.scaling import scratch
from hintwise.operators.textmodel import TextModel
from hintwise.plans.serving import analyze_batch
from hintwise.schemas import HINTS_TOP_K


@dataclass(frozen=True)
class CatalogNotes:
    """Which version of the catalog each batch has taken: one small file per batch, written before its answers."""

    spark: SparkSession
    path: str

    def _name(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def of(self, batch: int) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._name(batch)}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self._name(batch)).first().version

    def put(self, batch: int, version: int) -> None:
        self.spark.createDataFrame([(version,)], "version bigint").write.mode("overwrite").parquet(self._name(batch))


def analyze_stream(
    arrivals: DataFrame, model: TextModel, catalog: DataFrame | TextCatalog | CatalogStore, sink: str, checkpoint: str,
    top_k: int = HINTS_TOP_K, available_now: bool = False,
) -> StreamingQuery:
    """Run :func:`analyze_batch` on every micro-batch of ``arrivals(query_id, text)`` and write
    the records to ``sink``.

    Questions do not depend on each other, so there is no state and no watermark. A batch owns
    one folder and overwrites it when it is replayed, which makes the sink exactly-once. The
    catalog is weighted and packed before the stream starts, and what a batch writes for itself is
    deleted after it.

    With a :class:`CatalogStore` the catalog may change: a batch takes the newest version that is complete when it
    begins, and notes the number below ``checkpoint``. A batch that is replayed finds its note and answers as
    before, whatever has been published since. The store must hold a version.
    """
    ready = catalog if isinstance(catalog, TextCatalog | CatalogStore) else fit_catalog(catalog)
    loaded: dict[int, TextCatalog] = {}

    def chosen(batch: DataFrame, number: int) -> TextCatalog:
        if isinstance(ready, TextCatalog):
            return ready
        note = CatalogNotes(batch.sparkSession, f"{checkpoint}/catalog-versions")
        version = note.of(number)
        if version is None:
            version = ready.latest()
            if version is None:
                raise ValueError(f"no complete version below {ready.path}")
            note.put(number, version)
        if version not in loaded:
            loaded.clear()
            loaded[version] = ready.load(version)
        return loaded[version]

    def one_batch(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with scratch(batch.sparkSession):
            records = analyze_batch(batch, model, chosen(batch, number), top_k)
            records.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
