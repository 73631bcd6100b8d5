"""Live sample streams: segments, islands, stalls, and the latest-run pointer."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segtide.functions.times import micros
from segtide.operators.playlist import latest_pointer
from segtide.sources.sinks import batch_sink
from segtide.sources.state import StateTable


def _text(delta: timedelta) -> str:
    return f"{micros(delta)} microseconds"


def _timed(samples: DataFrame, lateness: timedelta) -> DataFrame:
    """Watermarks need a zoned timestamp and whole milliseconds."""
    return (samples.withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", f"{micros(lateness) // 1000} milliseconds"))


def stream_segments(samples: DataFrame, length: timedelta, lateness: timedelta) -> DataFrame:
    """Clock segments; a segment comes out once the watermark has passed its end."""
    return (_timed(samples, lateness).groupBy("node", F.window("ts", _text(length)).alias("_w"))
            .agg(F.count("*").alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select("node", F.col("_w.start").alias("seg_start"), F.col("_w.end").alias("seg_end"),
                    "n_samples", "first_ts", "last_ts"))


def stream_islands(samples: DataFrame, gap: timedelta, lateness: timedelta) -> DataFrame:
    """Islands of packets; packets exactly one gap apart belong together, as in the batch form.

    Session rows of one task are merged before the shuffle (a session setting), so a busy node
    sends its islands, not its packets.
    """
    return (_timed(samples, lateness).groupBy("node", F.session_window("ts", _text(gap)).alias("_w"))
            .agg(F.count("*").alias("n_packets"), F.max("ts").alias("last_ts"))
            .select("node", F.col("_w.start").alias("first_ts"), "last_ts", "n_packets"))


def stream_stall_alert(packets: DataFrame, timeout: timedelta, lateness: timedelta,
                       heartbeat: DataFrame | None = None) -> DataFrame:
    """One alert per silence over the timeout: the end of an island whose gap is the timeout.

    The island closes when the watermark reaches its last packet plus the timeout, which is the
    moment the alert is due. Packets alone move the watermark, so with nothing coming in from any node no alert is
    due yet; a ``heartbeat`` stream with a time ``ts`` (a rate source, or poll times) moves it without them.
    """
    beats = packets.select("node", "ts", F.lit(False).alias("_beat"))
    if heartbeat is not None:
        kind = packets.schema["ts"].dataType
        beats = beats.unionByName(heartbeat.select(F.lit(None).cast(packets.schema["node"].dataType).alias("node"),
                                                   F.col("ts").cast(kind).alias("ts"), F.lit(True).alias("_beat")))
    silent = (_timed(beats, lateness).groupBy("node", "_beat", F.session_window("ts", _text(timeout)).alias("_w"))
              # an aggregate: a test of the key itself would go below the watermark, and take the beats with it
              .agg(F.max("ts").alias("last_ts"), F.max(F.col("_beat").cast("int")).alias("_is_beat")).where("_is_beat = 0"))
    return (silent.select("node", F.col("last_ts").alias("silent_since"),
                    (F.col("last_ts") + F.lit(timeout)).alias("alert_at")))


POINTER = "node bigint, run_id bigint, written_at timestamp_ntz"


def latest_pointers(spark: SparkSession, path: str, schema: str = POINTER) -> StateTable:
    """The pointer table that ``stream_latest_pointer`` keeps; ``read()`` gives one row per node."""
    return StateTable(spark, path, schema, latest_pointer)


def stream_latest_pointer(runs: DataFrame, path: str, checkpoint: str, every: str | None = None,
                          schema: str = POINTER) -> StreamingQuery:
    """Keep one row per node. A batch writes the pointers it changes; the whole table is written anew every few batches."""
    table = latest_pointers(runs.sparkSession, path, schema)
    return batch_sink(runs, lambda batch, i: table.update(i, batch.select("node", "run_id", "written_at")), checkpoint, every=every)
