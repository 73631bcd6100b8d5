"""Sample-rate changes and gap filling on regular grids."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.functions.times import from_us, is_ntz, micros, slot_start, us
from segtide.operators import ordered
from segtide.operators.keys import per_key
from segtide.operators.schedule import segment_schedule
from segtide.operators.segments import pieces, within
from segtide.operators.steps import explode_steps
from segtide.sources.written import written


def resample_down(samples: DataFrame, step: timedelta) -> DataFrame:
    """Mean value per slot of ``step`` (a box filter)."""
    return (samples.groupBy("node", slot_start(us("ts"), step).alias("_slot"))
            .agg(F.avg("value").alias("value"), F.count("*").alias("n_samples"))
            .select("node", from_us("_slot", is_ntz(samples, "ts")).alias("slot"), "value", "n_samples"))


def resample_up(samples: DataFrame, step: timedelta, **kw) -> DataFrame:
    """Values on a grid of ``step`` by linear interpolation between neighbours.

    Samples of one instant are averaged first. There are no values outside a node's samples.
    """
    w = micros(step)
    points = samples.groupBy("node", us("ts").alias("_us")).agg(F.avg("value").alias("_v"))
    head = {"_head": (F.min("_us"), F.min("_head")), "_head_v": (F.min_by("_v", "_us"), F.min_by("_head_v", "_head"))}
    c = ordered.scanned(points, ["node"], "_us", head,
                        after={"_after": F.min("_head"), "_after_v": F.min_by("_head_v", "_head")}, **kw)
    inside = ordered.chunk_window(["node"], "_us")
    c = (c.withColumn("_next", F.coalesce(F.lead("_us").over(inside), F.col("_after")))
         .withColumn("_next_v", F.coalesce(F.lead("_v").over(inside), F.col("_after_v"))))
    first = slot_start(F.col("_us") + F.lit(w - 1), w)
    last = F.coalesce(F.col("_next") - 1, F.col("_us"))  # the node's last sample stands alone
    share = (F.col("_grid") - F.col("_us")) / (F.col("_next") - F.col("_us"))
    value = F.when(F.col("_grid") == F.col("_us"), F.col("_v")).otherwise(
        F.col("_v") + (F.col("_next_v") - F.col("_v")) * share)
    return (explode_steps(ordered.unchunk(c, ["node"]), first, last, w, "_grid")
            .select("node", from_us("_grid", is_ntz(samples, "ts")).alias("slot"), value.alias("value")))


def gap_fill(samples: DataFrame, segments: DataFrame, step: timedelta, **kw) -> DataFrame:
    """On the grid of every segment, counted from its own start: slot mean less the segment's mean, and 0 where
    data is missing.

    Samples are summed up between the bounds of all slots, then put together per slot; the window covers the
    slots of one segment.
    """
    whole_segments = segments.select("node", F.col("seg_start").alias("segment"), F.col("seg_end").alias("end")).distinct()
    grid = segment_schedule(whole_segments.withColumn("start", F.col("segment")), step)
    slots, _ = written(grid.select("node", "segment", "end", F.col("seg_start").alias("slot"), F.col("seg_end").alias("slot_end")), "grid")
    parts = pieces(samples, slots, "slot", "slot_end", F.sum("value").alias("_v"), F.count("value").alias("_c"), **kw)
    key = ["node", "segment", "end", "slot"]
    sums = per_key(within(slots, parts, "slot", "slot_end"), key, F.sum("_v").alias("_sum"), F.sum("_c").alias("_n"))
    filled = slots.join(sums, key, "left")
    whole = W.partitionBy("node", "segment", "end")
    mean = F.sum("_sum").over(whole) / F.sum("_n").over(whole)
    return filled.select("node", "segment", "slot", F.coalesce(F.col("_sum") / F.col("_n") - mean, F.lit(0.0)).alias("value"))
