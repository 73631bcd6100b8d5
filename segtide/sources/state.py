"""A small table kept over the batches of a stream: snapshots and the changes since.

Every batch adds a folder of changes. Every few batches the merged table is written as a snapshot, which counts once it is complete
(its ``_SUCCESS`` file, which Spark writes last), and what no batch can need any more is deleted: the number of folders stays flat, and
a batch reads one snapshot and a few changes. One generation is kept, so that a repeated batch, and
a reader that has just looked, find what they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class StateTable:
    """Rows of ``schema`` below ``path``; ``merge`` makes the table of rows that several batches have brought, and gives the same for its own
    results and new rows (a maximum, a sum, the last of each key)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = 8):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path.rstrip("/"), schema, merge, every

    def batches(self, kind: str) -> list[int]:
        """Batch ids of the complete folders of ``changes`` or ``snapshot``."""
        store, place = _folder(self.spark, f"{self.path}/{kind}")
        if not store.exists(place):
            return []
        names = [f.getPath().getName() for f in store.listStatus(place)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.removeprefix("batch_id=")) for n in names
                      if n.startswith("batch_id=") and store.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _sources(self, before: int | None) -> list[str]:
        def earlier(kind: str) -> list[int]:
            return [i for i in self.batches(kind) if before is None or i < before]

        newest = max(earlier("snapshot"), default=None)
        found = [] if newest is None else [f"{self.path}/snapshot/batch_id={newest}"]
        return found + [f"{self.path}/changes/batch_id={i}" for i in earlier("changes") if newest is None or i > newest]

    def read(self, before: int | None = None) -> DataFrame:
        """The table after all batches so far, or after those before a batch."""
        sources = self._sources(before)
        rows = self.spark.read.schema(self.schema).parquet(*sources) if sources else self.spark.createDataFrame([], self.schema)
        return self.merge(rows)

    def update(self, batch_id: int, rows: DataFrame) -> None:
        """Add what a batch brings; a repeated batch replaces what it brought before."""
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        if batch_id % self.every == self.every - 1:
            self.read(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot/batch_id={batch_id}")
            kept = [i for i in self.batches("snapshot") if i < batch_id][-1:]
            for kind in ("snapshot", "changes"):
                for i in self.batches(kind):
                    if kept and (i < kept[0] or (kind == "changes" and i == kept[0])):
                        store, place = _folder(self.spark, f"{self.path}/{kind}/batch_id={i}")
                        store.delete(place, True)
