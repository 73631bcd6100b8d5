"""Playlists and the pointer to a node's latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions.times import DAY, slot_number, us

# Lines a player expects.
HEADER = "#EXTM3U"
TARGET = "#EXT-X-TARGETDURATION:"
END = "#EXT-X-ENDLIST"


def _seconds() -> Column:
    return (us("seg_end") - us("seg_start")) / F.lit(1_000_000)


def playlist_lines(segments: DataFrame) -> DataFrame:
    """Add ``line``: the two text lines of a segment."""
    return segments.withColumn("line", F.format_string("#EXTINF:%.6f,\n%s", _seconds(), F.col("ts_name")))


def _in_order(order: list[str], text: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), "\n")


def _joined_lines(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segment lines of each playlist in time order.

    Copies of a segment are merged first. Then it is built in two steps, per day and per
    playlist, so that single segments are only ever gathered for one day.
    """
    day = slot_number(us("seg_start"), DAY).alias("_day")
    once = segments.groupBy(*by, "seg_start", "ts_name").agg(F.max("seg_end").alias("seg_end"))
    daily = (playlist_lines(once).groupBy(*by, day)
             .agg(_in_order(["seg_start", "ts_name"], "line").alias("_text"), F.max(_seconds()).alias("_longest")))
    return daily.groupBy(*by).agg(_in_order(["_day"], "_text").alias("lines"),
                                  F.max("_longest").alias("longest"))


def _body(lines: Column, longest: Column) -> Column:
    target = F.concat(F.lit(TARGET), F.ceil(longest).cast("string"))
    return F.concat_ws("\n", F.lit(HEADER), target, lines, F.lit(END))


def build_playlist(segments: DataFrame, by: list[str]) -> DataFrame:
    """One playlist text per group (node and run, or node and day)."""
    return _joined_lines(segments, by).select(*by, _body(F.col("lines"), F.col("longest")).alias("body"))


def append_playlist(playlists: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Drop the end line of each text, add the lines of new segments, end it again.

    Segments whose name is in the text already are not added again, and the target length rises with the
    longest new one. Groups without a text yet get a new playlist; groups without new segments stay as they are.
    """
    listed = playlists.select(*by, F.explode(F.split("body", "\n")).alias("ts_name"))
    segments = segments.join(listed.where(~F.startswith("ts_name", F.lit("#"))), [*by, "ts_name"], "left_anti")
    lines = F.split("body", "\n")
    kept = F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n")
    told = F.regexp_extract("body", TARGET + "([0-9]+)", 1)
    kept = F.regexp_replace(kept, F.lit(TARGET + "[0-9]+"), F.concat(F.lit(TARGET), F.greatest(
        F.try_to_number(told, F.lit("9999999999")).cast("bigint"), F.ceil("longest")).cast("string")))
    grown = F.concat_ws("\n", kept, F.col("lines"), F.lit(END))
    body = (F.when(F.col("body").isNull(), _body(F.col("lines"), F.col("longest")))
            .when(F.col("lines").isNull(), F.col("body")).otherwise(grown))
    return (playlists.join(_joined_lines(segments, by), by, "full")
            .select(*by, body.alias("body")))


def latest_pointer(runs: DataFrame) -> DataFrame:
    """The run written last, per node; a backfill written later may move it back."""
    last = F.max(F.struct("written_at", "run_id")).alias("_last")
    return runs.groupBy("node").agg(last).select("node", "_last.run_id", "_last.written_at")
