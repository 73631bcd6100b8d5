"""The play-out queue: each file waits, plays, and is forgotten."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.times import micros

OUTPUT = "node bigint, filepath string, state string, at timestamp"


def stream_playout_queue(converted: DataFrame, delay: timedelta, lateness: timedelta) -> DataFrame:
    """``playing`` when a file's delay is over and ``expired`` when it has played, in event time.

    Each file becomes two entries that are due at a time of their own. An entry is held as a
    session of one file whose gap reaches one microsecond past that time: Spark keeps it in
    state, merges copies of the file, and gives it out and frees it once the watermark is past
    it. State is keyed by file, not by node, so a busy node is spread over all tasks.
    """
    length = (F.col("duration_s") * 1_000_000).cast("bigint")
    wait = F.lit(micros(delay))
    entries = F.explode(F.array(F.struct(F.lit("playing").alias("state"), wait.alias("wait_us")),
                                F.struct(F.lit("expired").alias("state"), (wait + length).alias("wait_us"))))
    held = (converted.withColumn("file_time", F.col("file_time").cast("timestamp"))
            .withWatermark("file_time", f"{micros(lateness) // 1000} milliseconds")
            .select("node", "filepath", "file_time", entries.alias("_e"))
            .select("node", "filepath", "file_time", "_e.state", "_e.wait_us"))
    due = F.session_window("file_time", F.concat((F.col("wait_us") + 1).cast("string"), F.lit(" microseconds")))
    return (held.groupBy("node", "filepath", "state", due.alias("_w")).agg(F.count("*").alias("_copies"))
            .select("node", "filepath", "state",
                    (F.col("_w.end") - F.lit(timedelta(microseconds=1))).alias("at")))
