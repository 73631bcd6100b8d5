"""Stream sinks that can be repeated safely: every batch owns its folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch to its own folder; a repeated batch replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a sink, with their ``batch_id``; none before the first batch."""
    schema += ", batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run on a fixed phase (``every``), or over all that is there now."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a parquet folder, exactly once."""
    return start(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, every)


def batch_sink(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append", every: str | None = None) -> StreamingQuery:
    return start(stream.writeStream.outputMode(mode).foreachBatch(each), checkpoint, every)


def tee_sinks(stream: DataFrame, outputs: dict[str, tuple[Callable[[DataFrame], DataFrame], str]],
              checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One input, several outputs: name -> (transform, path). The batch is read once.

    A segment may reach over two batches, so transforms that aggregate write partial figures
    and the reader combines them.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for transform, path in outputs.values():
                write_batch(transform(batch), path, batch_id)
        finally:
            batch.unpersist()

    return batch_sink(stream, each, checkpoint, every=every)
