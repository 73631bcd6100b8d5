"""File names, object keys and the times inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions.times import us
from segtide.operators.keys import per_key

# Layouts of the names that other systems read.
ISO_MICROS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
SEGMENT_STAMP = "yyyy-MM-dd'T'HH-mm-ss-SSS"
ARCHIVE_STAMP = "yyyy-MM-dd_HH-mm-ss"
DAY_STAMP = "yyyy-MM-dd"
DAY_PATH = "yyyy/MM/dd"
TAIL_CHARS = 12


def parse_file_time(name: Column, prefix: str, postfix: str) -> Column:
    """Time inside a file name; null where what is left is not a full ISO date and time."""
    text = F.replace(F.replace(name, F.lit(prefix)), F.lit(postfix))
    parsed = F.call_function("try_to_timestamp", text).cast("timestamp_ntz")
    return F.when(text.rlike(ISO_MICROS), parsed)


def full_url(url: Column, filepath: Column) -> Column:
    return F.concat(url, F.lit("/"), filepath)


def short_name(filepath: Column, extension: str) -> Column:
    """Name without its last twelve characters, with a new extension and no colons."""
    stem = F.left(filepath, F.greatest(F.length(filepath) - TAIL_CHARS, F.lit(0)))
    return F.replace(F.concat(stem, F.lit(extension)), F.lit(":"), F.lit("-"))


def derive_names(files: DataFrame) -> DataFrame:
    """Add ``wav_name``, ``ts_name`` and ``name_collision``.

    The shortened name has no fraction of a second, so files of one second collide. Names are
    counted with partial aggregation; only the colliding ones are joined back, so a name that
    many copies share never becomes one window partition.
    """
    named = files.withColumn("wav_name", short_name(F.col("filepath"), "wav")) \
                 .withColumn("ts_name", short_name(F.col("filepath"), "ts"))
    shared = (per_key(named, ["ts_name"], F.count("*").alias("_n"))
              .where("_n > 1").select("ts_name", F.lit(True).alias("_shared")))
    return (named.join(shared, "ts_name", "left")
            .withColumn("name_collision", F.coalesce("_shared", F.lit(False))).drop("_shared"))


def segment_names(segments: DataFrame, prefix: str) -> DataFrame:
    """Add ``subdir``, ``wav_name`` and ``ts_name``; milliseconds are cut, not rounded."""
    stamp = F.date_format("seg_start", SEGMENT_STAMP)
    return segments.select(
        "*",
        F.date_format("seg_start", DAY_STAMP).alias("subdir"),
        F.concat(stamp, F.lit(".wav")).alias("wav_name"),
        F.concat(F.lit(prefix), stamp, F.lit(".ts")).alias("ts_name"))


def archive_name(start: Column, node: Column, rate: Column, channels: Column) -> Column:
    return F.concat(F.date_format(start, ARCHIVE_STAMP), F.lit("_"), node, F.lit("-"),
                    rate.cast("string"), F.lit("-"), channels.cast("string"), F.lit(".flac"))


def live_name(index: Column) -> Column:
    """At least three digits; larger numbers are not cut."""
    return F.format_string("live%03d.ts", index)


def object_key(path: Column, filename: Column, root: str = "/tmp") -> Column:
    """Path below ``root``, then the file name."""
    base = F.lit(root.rstrip("/") + "/")
    below = F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))) \
             .otherwise(path)
    return F.concat(F.regexp_replace(below, "/+$", ""), F.lit("/"), filename)


def run_id(started_at: Column) -> Column:
    """Whole epoch seconds of a run's start."""
    return F.call_function("div", us(started_at), F.lit(1_000_000))
