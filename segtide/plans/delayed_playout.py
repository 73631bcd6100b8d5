"""Archive names to per-node play-out counts with a fixed delay."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.functions.names import short_name
from segtide.operators.catalog import anti_done, build_catalog, eligible_files, queue_state
from segtide.operators.schedule import plan_listing_days
from segtide.sources.layout import scan_planned_days


def listed_names(spark: SparkSession, path: str, now: datetime, delay: timedelta, schema: str, base: str = "archive") -> DataFrame:
    """Names of a listing laid out by day, of the days that a pass at ``now`` lists: other days are not read."""
    request = spark.range(1).select(F.lit(now).cast("timestamp_ntz").alias("now"), F.lit(delay).alias("delay"))
    return scan_planned_days(spark, path, plan_listing_days(request, base), schema).drop("day")


def selected_files(names: DataFrame, done: DataFrame, now: datetime, delay: timedelta, segment: timedelta,
                   prefix: str, postfix: str) -> DataFrame:
    """Files to convert in this pass.

    The age test comes before the ledger join, so the join meets the few files in the window.
    """
    good, _ = build_catalog(names, prefix, postfix)
    return anti_done(eligible_files(good, now, delay, segment), done)


def delayed_playout(names: DataFrame, done: DataFrame, now: datetime, delay: timedelta, segment: timedelta,
                    prefix: str, postfix: str, later: timedelta) -> DataFrame:
    """Queue counts per node at a pass ``later`` than the one that selected the files.

    The listing is read once: files are counted per node, output name and state, and the
    collisions of a name come from those counts, of which there are few per name.
    """
    chosen = queue_state(selected_files(names, done, now, delay, segment, prefix, postfix), now + later, delay)
    counts = chosen.groupBy("node", "state", short_name(F.col("filepath"), "ts").alias("_name")).agg(
        F.count("*").alias("_n"))
    counts = counts.withColumn("_shared", F.sum("_n").over(W.partitionBy("_name")) > 1)

    def total(when) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0))

    state = F.col("state")
    return counts.groupBy("node").agg(
        F.sum("_n").alias("selected"),
        total(state == "expired").alias("expired"),
        total(state == "playing").alias("playing"),
        total(state == "pending").alias("pending"),
        total(state != "pending").alias("deleted"),
        total(F.col("_shared")).alias("collisions"))
