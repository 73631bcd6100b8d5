"""Play-out: what is on air at a tick, list timelines, loops, and merged conversions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.times import micros, us
from segtide.operators import ordered
from segtide.operators.intervals import stab_join
from segtide.operators.keys import per_key
from segtide.operators.steps import explode_steps


def playing_at(files: DataFrame, ticks: DataFrame, delay: timedelta) -> DataFrame:
    """Pairs of a tick and a file that plays then: delayed start < tick <= delayed end."""
    spans = (files.withColumn("_start", us("file_time") + micros(delay))
             .withColumn("_end", F.col("_start") + (F.col("duration_s") * 1_000_000).cast("bigint")))
    points = ticks.withColumn("_tick", us("tick"))
    return stab_join(spans, points, "_start", "_end", "_tick").drop("_start", "_end", "_tick")


def on_air_top1(playing: DataFrame) -> DataFrame:
    """The one file on air per node and tick: the latest. A maximum, so it combines partially."""
    best = F.max(F.struct("file_time", "filepath")).alias("_best")
    return (playing.groupBy("node", "tick").agg(best)
            .select("node", "tick", "_best.file_time", "_best.filepath"))


def concat_timeline(items: DataFrame, width: int = 1 << 20, **kw) -> DataFrame:
    """Add ``offset_s``: start of each item when a list is played in order of ``pos``.

    Lists are cut into ranges of positions, so a long list is summed by many tasks. Durations are summed
    as whole microseconds, so the result doesn't depend on the cuts.
    """
    whole = F.round(F.col("duration_s") * 1_000_000).cast("bigint")
    timed = ordered.with_running_sum(items, ["list_id"], "pos", ["pos"], whole, "_offset_us", width=width, **kw)
    return timed.withColumn("offset_s", F.col("_offset_us") / F.lit(1_000_000)).drop("_offset_us")


def loop_expand(items: DataFrame, n: int) -> DataFrame:
    """Play every list ``n`` times: repeat its items, keeping the order in ``pos`` (from 0).

    A repeat is as long as the list's range of positions, so gaps in ``pos`` keep the order too. That range
    is a partial aggregate joined back; the repeats are generated per row.
    """
    length = per_key(items, ["list_id"], (F.max("pos") - F.min("pos") + 1).alias("_len"), F.min("pos").alias("_lowest"))
    return (explode_steps(items.join(length, "list_id"), F.lit(0), F.lit(n - 1), 1, "loop_no")
            .withColumn("pos", F.col("loop_no") * F.col("_len") + F.col("pos") - F.col("_lowest"))
            .drop("_len", "_lowest"))


def accumulate_converted(batches: list[DataFrame]) -> DataFrame:
    """One row per file over several conversion attempts: the earliest attempt stays."""
    both = None
    for attempt, batch in enumerate(batches):
        part = batch.withColumn("attempt", F.lit(attempt))
        both = part if both is None else both.unionByName(part)
    rest = [c for c in both.columns if c != "filepath"]
    kept = F.min(F.struct("attempt", *[c for c in rest if c != "attempt"])).alias("_kept")
    return both.groupBy("filepath").agg(kept).select("filepath", *[F.col(f"_kept.{c}") for c in rest])
