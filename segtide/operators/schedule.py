"""Listing days and fixed-length segment schedules."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.names import DAY_PATH
from segtide.functions.times import from_us, is_ntz, micros, slot_start, us
from segtide.operators.keys import per_key
from segtide.operators.segments import pieces, within
from segtide.operators.steps import explode_steps
from segtide.sources.written import written


def plan_listing_days(requests: DataFrame, base: str) -> DataFrame:
    """One row per request and day path between ``now - delay`` and ``now``, both ends included."""
    days = F.sequence(F.to_date(F.col("now") - F.col("delay")), F.to_date("now"))
    return (requests.withColumn("day", F.explode(days))
            .withColumn("day_path", F.concat(F.lit(base.rstrip("/") + "/"), F.date_format("day", DAY_PATH))))


def segment_schedule(ranges: DataFrame, length: timedelta) -> DataFrame:
    """Half-open segments of every range ``[start, end)``; the last one ends with the range."""
    steps = explode_steps(ranges, us("start"), us("end") - 1, micros(length), "_at")
    return (steps.withColumn("seg_start", from_us("_at", is_ntz(ranges, "start")))
            .withColumn("seg_end", F.least(F.col("seg_start") + F.lit(length), F.col("end"))).drop("_at"))


def near_and_backfill(requests: DataFrame, length: timedelta, near: timedelta = timedelta(hours=8),
                      back: timedelta = timedelta(hours=24), origin: int = 0) -> DataFrame:
    """Segments of the near-live and the delayed range of every request, each once per node.

    Both ranges use one grid from ``origin``, so equal segments have equal keys. A segment that
    several requests reach keeps its latest end, and counts as near if any near range holds it.
    """
    def part(span: timedelta, rank: int) -> DataFrame:
        first = from_us(slot_start(us(F.col("now") - F.lit(span)), length, origin), is_ntz(requests, "now"))
        ranges = requests.select("node", first.alias("start"), F.col("now").alias("end"))
        return segment_schedule(ranges, length).withColumn("_rank", F.lit(rank))

    merged = part(near, 0).unionByName(part(back, 1)).groupBy("node", "seg_start").agg(
        F.max("seg_end").alias("seg_end"), F.min("_rank").alias("_rank"))
    return merged.withColumn("origin", F.when(F.col("_rank") == 0, "near").otherwise("backfill")).drop("_rank")


def skip_existing(segments: DataFrame, present: DataFrame, on: tuple[str, ...] = ("node", "subdir", "ts_name")) -> DataFrame:
    """Scheduled segments that are not stored yet."""
    return segments.join(per_key(present, list(on)), list(on), "left_anti")


def with_sample_counts(segments: DataFrame, samples: DataFrame, **kw) -> DataFrame:
    """Add ``n_samples`` per scheduled segment (0 where no data came back): samples with
    ``seg_start <= ts < seg_end``, whatever grid or length the segments have, and where they overlap.

    Samples are counted between the segments' bounds; the counts are put together per segment. The segments' times are
    written once, for all that is asked of them.
    """
    spans, _ = written(segments.select("node", "seg_start", "seg_end").distinct(), "spans")
    parts = pieces(samples, spans, "seg_start", "seg_end", F.count("*").alias("_n"), **kw)
    counts = per_key(within(spans, parts, "seg_start", "seg_end"), ["node", "seg_start", "seg_end"], F.sum("_n").alias("n_samples"))
    return (segments.join(counts, ["node", "seg_start", "seg_end"], "left").select(*segments.columns, "n_samples")
            .withColumn("n_samples", F.coalesce("n_samples", F.lit(0))))


def missing_segments(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Scheduled segments without any sample in ``[seg_start, seg_end)``."""
    return with_sample_counts(segments, samples).where("n_samples = 0").drop("n_samples")
