"""Cutting sample streams: by run, by clock, and the figures of a segment."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.functions.times import from_us, is_ntz, micros, us
from segtide.operators import ordered
from segtide.operators.intervals import stab_join


def newest_start(samples: DataFrame, starts: DataFrame, out: str, **kw) -> DataFrame:
    """Add ``out``: the newest of the node's starts (``node, _us``) at or before ``ts``, in microseconds.

    Starts join the samples as rows of their own. The newest start so far is a running
    maximum inside a time chunk; each chunk is handed the maximum of the earlier ones, out of the written
    slots (see ``ordered``). Samples of one instant may be cut apart in any way, as long as a start then comes first.
    """
    marks = starts.select("node", "_us").distinct().withColumn("_start", F.col("_us")).withColumn("_tie", F.lit(-1).cast("bigint"))
    plain = [f.name for f in samples.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    spread = F.pmod(F.xxhash64(*plain), F.lit(1 << 40))
    both = (samples.withColumn("_us", us("ts")).withColumn("_sample", F.lit(True)).withColumn("_tie", spread)
            .unionByName(marks, allowMissingColumns=True))
    c = ordered.scanned(both, ["node"], "_us", ordered.greatest("_newest", "_start"), before={"_before": F.max("_newest")},
                        tie="_tie", **kw)
    so_far = ordered.chunk_window(["node"], "_us").rangeBetween(W.unboundedPreceding, 0)
    found = c.withColumn(out, F.coalesce(F.max("_start").over(so_far), F.col("_before")))
    return ordered.unchunk(found.where("_sample"), ["node"]).drop("_us", "_start", "_sample", "_before", "_tie")


def asof_run(samples: DataFrame, runs: DataFrame, **kw) -> DataFrame:
    """Add ``run_start_us`` and ``run_id``: the node's newest run started at or before ``ts``."""
    tied = newest_start(samples, runs.select("node", us("started_at").alias("_us")), "run_start_us", **kw)
    return tied.withColumn("run_id", F.call_function("div", F.col("run_start_us"), F.lit(1_000_000)))


def cut_runs(tied: DataFrame, length: timedelta | dict[str, str]) -> DataFrame:
    """Fixed-length cuts of samples tied to their run (``asof_run``); one row per segment.

    ``length`` may instead map names to columns of ``tied`` with a node's own lengths in microseconds: all cuts are made in one pass
    and say their name in ``kind``; rows without a positive length are not cut.
    """
    by = ["node", "run_start_us", "run_id", "seg_index", "_length"]
    if isinstance(length, dict):
        cuts = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(own).cast("bigint").alias("_length")) for kind, own in length.items()]))
        cut, by = tied.withColumn("_cut", cuts).select(*tied.columns, "_cut.*"), [*by, "kind"]
    else:
        cut = tied.withColumn("_length", F.lit(micros(length)))
    cut = cut.where("run_start_us is not null and _length > 0")
    start = F.col("run_start_us") + F.col("seg_index") * F.col("_length")
    return (cut.withColumn("seg_index", F.call_function("div", us("ts") - F.col("run_start_us"), F.col("_length")))
            .groupBy(*by)
            .agg(F.count("*").alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .withColumn("seg_start", from_us(start, is_ntz(tied, "ts"))).drop("_length"))


def run_segments(samples: DataFrame, runs: DataFrame, length: timedelta, **kw) -> DataFrame:
    """Fixed-length cuts counted from the start of the run, index 0 first; one row per segment."""
    return cut_runs(asof_run(samples, runs, **kw), length)


def clock_segments(samples: DataFrame, length: timedelta, origin: timedelta = timedelta(0)) -> DataFrame:
    """Fixed-length cuts from a given origin; one row per node and segment."""
    def text(delta: timedelta) -> str:
        return f"{micros(delta)} microseconds"

    cut = F.window("ts", text(length), text(length), text(origin))
    return (samples.groupBy("node", cut.alias("_w"))
            .agg(F.count("*").alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select("node", F.col("_w.start").alias("seg_start"), F.col("_w.end").alias("seg_end"),
                    "n_samples", "first_ts", "last_ts"))


def segment_duration(samples: DataFrame, by: list[str]) -> DataFrame:
    """Duration, sample count and sampling rate of every segment."""
    span = (us(F.max("ts")) - us(F.min("ts"))) / F.lit(1_000_000)
    return (samples.groupBy(*by).agg(span.alias("duration_s"), F.count("*").alias("n_samples"))
            .withColumn("sample_rate", F.when(F.col("duration_s") > 0,
                                              (F.col("n_samples") - 1) / F.col("duration_s"))))


def pieces(samples: DataFrame, spans: DataFrame, start: str, end: str, *figures: Column, **kw) -> DataFrame:
    """Samples summed up between neighbouring bounds of a node's spans (``node``, ``start``, ``end``): ``node, _piece`` (start in
    microseconds) and the figures, for pieces with samples.

    Every sample lies in one piece, that of the newest bound before it, whether spans overlap or not, so it is
    shuffled once; a span is made of whole pieces (``within``). Samples outside all spans' times aren't read.
    """
    low, high = spans.agg(F.min(us(start)), F.max(us(end))).first()  # one row
    ntz, ts = is_ntz(samples, "ts"), F.col("ts")
    held = samples.where((ts >= from_us(F.lit(low).cast("bigint"), ntz)) & (ts < from_us(F.lit(high).cast("bigint"), ntz)))
    bounds = spans.select("node", us(start).alias("_us")).unionByName(spans.select("node", us(end).alias("_us")))
    return newest_start(held, bounds, "_piece", **kw).where("_piece is not null").groupBy("node", "_piece").agg(*figures)


def within(spans: DataFrame, parts: DataFrame, start: str, end: str) -> DataFrame:
    """Pairs of a span and a piece that it holds (``start <= piece < end``); the piece's node is dropped."""
    open_ = spans.withColumn("_from", us(start) - 1).withColumn("_to", us(end) - 1)
    return stab_join(open_, parts.withColumnRenamed("node", "_node"), "_from", "_to", "_piece", keys={"node": "_node"}).drop("_from", "_to", "_node")
