"""Overruns, clock islands and stalls in packet streams.

All look at neighbouring packets of a node, across time chunks (see ``ordered``). ``tie`` names a whole number that
orders packets of one instant.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.functions.times import from_us, instant, is_ntz, micros, slot_number, type_of, us
from segtide.operators import ordered
from segtide.sources.written import written

KEY = ["node"]
EXACT = "decimal(38,0)"


def xrun_flags(packets: DataFrame, gap: timedelta, tie: str = "event_id", **kw) -> DataFrame:
    """Add ``gap_us`` (time since the node's packet before) and ``xrun``.

    Only the first packet after a gap over the threshold is flagged.
    """
    timed = ordered.with_previous_time(packets.withColumn("_us", us("ts")), KEY, "_us", ["_us", tie], tie=tie, **kw)
    out = timed.withColumn("gap_us", F.col("_us") - F.col("prev_us"))
    return (out.drop("_us", "prev_us")
            .withColumn("xrun", F.coalesce(F.col("gap_us") > micros(gap), F.lit(False))))


def _stretches(timed: DataFrame, gap: timedelta) -> DataFrame:
    """Packets summed up by node and slot as long as the gap: no island begins inside a slot but with its first packet."""
    return (timed.groupBy("node", slot_number(F.col("_us"), max(micros(gap), 1)).alias("_slot"))
            .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("_n")))


def _in_islands(stretches: DataFrame, gap: timedelta, **kw) -> DataFrame:
    """Add to written rows that each lie in one island (``_first, _last, _n`` packets, apart in time): ``island_us`` (start of the island)
    and ``_place`` (packets of the island before the row).

    Starts only grow along a stream, so the current one is a running maximum, and so is the number of packets before it.
    """
    c = ordered.scanned(stretches, KEY, "_first", ordered.greatest("_tail", "_last") | ordered.total("_rows", F.sum("_n")),
                        before={"_before": F.max("_tail"), "_offset": F.sum("_rows")}, tie="_last", **kw)
    inside = ordered.chunk_window(KEY, "_first", "_last")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    prev = F.coalesce(F.max("_last").over(earlier), F.col("_before"))
    ahead = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + F.coalesce("_offset", F.lit(0))
    c = c.withColumn("_prev", prev).withColumn("_ahead", ahead)
    opens = F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") > micros(gap))
    marked = ordered.unchunk(c.withColumn("_start", F.when(opens, F.col("_first"))).withColumn("_start_at", F.when(opens, F.col("_ahead")))
                             .drop("_before", "_offset", "_prev"), KEY)
    c = ordered.scanned(marked, KEY, "_first", ordered.greatest("_s", "_start") | ordered.greatest("_r", "_start_at"),
                        before={"_from": F.max("_s"), "_from_at": F.max("_r")}, tie="_last", **kw)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    return ordered.unchunk(
        c.withColumn("island_us", F.coalesce(F.max("_start").over(so_far), F.col("_from")))
        .withColumn("_place", F.col("_ahead") - F.coalesce(F.max("_start_at").over(so_far), F.col("_from_at")))
        .drop("_start", "_start_at", "_from", "_from_at", "_ahead"), KEY)


def _islands(packets: DataFrame, gap: timedelta, **kw) -> DataFrame:
    """Start, last packet time and packet count of every island, out of one read of the packets."""
    stretches, _ = written(_stretches(packets.withColumn("_us", us("ts")), gap), "stretches")
    return _in_islands(stretches, gap, **kw).groupBy("node", "island_us").agg(
        F.max("_last").alias("_last"), F.sum("_n").alias("n_packets"))


def reset_islands(packets: DataFrame, gap: timedelta, **kw) -> DataFrame:
    """First and last packet time and packet count of every island. A gap strictly over the threshold starts one.

    The packets are read once, and summed up in slots of the gap's length; the islands come from the slots.
    """
    ntz = is_ntz(packets, "ts")
    return _islands(packets, gap, **kw).select(
        "node", from_us("island_us", ntz).alias("first_ts"), from_us("_last", ntz).alias("last_ts"), "n_packets")


def with_island(packets: DataFrame, gap: timedelta, tie: str = "event_id", **kw) -> DataFrame:
    """Add ``island_us`` (start of the packet's island) and ``packet_no`` (from 0 in the island).

    Island starts join the packets as rows of their own, with the packets of the node before them.
    """
    islands, _ = written(_islands(packets, gap, **kw), "islands")
    starts = (ordered.with_running_sum(islands, KEY, "island_us", ["island_us"], F.col("n_packets"), "_start_at", **kw)
              .select("node", F.col("island_us").alias("_us"), F.col("island_us").alias("_start"), "_start_at",
                      F.lit(None).cast("bigint").alias("_tie")))
    both = (packets.withColumn("_us", us("ts")).withColumn("_tie", F.col(tie).cast("bigint")).withColumn("_packet", F.lit(1))
            .unionByName(starts, allowMissingColumns=True))
    c = ordered.scanned(both, KEY, "_us", ordered.greatest("_s", "_start") | ordered.greatest("_r", "_start_at") | ordered.total("_rows", F.sum("_packet")),
                        before={"_from": F.max("_s"), "_from_at": F.max("_r"), "_offset": F.sum("_rows")}, tie="_tie", **kw)
    zero = F.lit(0)
    so_far = ordered.chunk_window(KEY, "_us", F.coalesce("_packet", zero), "_tie").rowsBetween(W.unboundedPreceding, 0)
    number = F.coalesce(F.sum("_packet").over(so_far), zero) + F.coalesce("_offset", zero) - 1
    found = (c.withColumn("island_us", F.coalesce(F.max("_start").over(so_far), F.col("_from")))
             .withColumn("packet_no", number - F.coalesce(F.max("_start_at").over(so_far), F.col("_from_at"))))
    return ordered.unchunk(found.where("_packet = 1"), KEY).drop(
        "_tie", "_packet", "_start", "_start_at", "_from", "_from_at", "_offset")


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column, yy: Column) -> list[Column]:
    """Slope, intercept and r2 of a least-squares line from exact sums of whole numbers.

    The sums are shifted by the whole part of the means while they are exact, so that little is lost in doubles.
    """
    def double(c: Column) -> Column:
        return c.cast("double")

    mx, my = (F.call_function("div", s, n).cast("decimal(18,0)") for s in (x, y))
    sxx = (xx - 2 * mx * x + n * mx * mx).cast(EXACT)
    sxy = (xy - mx * y - my * x + n * mx * my).cast(EXACT)
    syy = (yy - 2 * my * y + n * my * my).cast(EXACT)
    rx, ry = double(x - n * mx), double(y - n * my)
    cxx, cxy, cyy = (double(s) - a * b / double(n) for s, a, b in ((sxx, rx, rx), (sxy, rx, ry), (syy, ry, ry)))
    slope = F.when(cxx > 0, cxy / cxx)
    intercept = double(my) + ry / double(n) - slope * (double(mx) + rx / double(n))
    return [slope, intercept, F.when(cxx > 0, F.when(cyy > 0, cxy * cxy / (cxx * cyy)).otherwise(1.0))]


def clock_fit(packets: DataFrame, gap: timedelta, tie: str = "event_id", **kw) -> DataFrame:
    """Least-squares clock of every island: seconds since its start against packet number.

    Sums of whole numbers (packet number and microseconds, their products and squares) are taken inside chunks as long as the gap,
    written, and moved to the island each chunk lies in: exact, so equal for every way of cutting.
    """
    timed = packets.withColumn("_us", us("ts"))
    c = ordered.scanned(timed, KEY, "_us", {}, width=max(micros(gap), 1), tie=tie, **kw)
    inside = ordered.chunk_window(KEY, "_us", tie)
    chunk = ordered.chunk_columns(KEY)
    x, y = F.row_number().over(inside) - 1, F.col("_us") - F.min("_us").over(W.partitionBy(*chunk))
    whole = c.withColumn("_x", x.cast("decimal(18,0)")).withColumn("_y", y.cast("decimal(18,0)"))

    def exact(column: Column) -> Column:
        return F.sum(column).cast(EXACT)

    sums = whole.groupBy(*chunk).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("_n"), exact(F.col("_x")).alias("_sx"), exact(F.col("_y")).alias("_sy"),
        exact(F.col("_x") * F.col("_x")).alias("_sxx"), exact(F.col("_x") * F.col("_y")).alias("_sxy"), exact(F.col("_y") * F.col("_y")).alias("_syy"))
    parts = _in_islands(written(ordered.unchunk(sums, KEY), "moments")[0], gap, **kw)
    n, a, b = F.col("_n"), F.col("_place").cast("decimal(18,0)"), (F.col("_first") - F.col("island_us")).cast("decimal(18,0)")
    sx, sy, sxx, sxy, syy = (F.col(c) for c in ("_sx", "_sy", "_sxx", "_sxy", "_syy"))
    moved = parts.groupBy("node", "island_us").agg(
        F.sum("_n").alias("n_packets"), exact(sx + n * a).alias("x"), exact(sy + n * b).alias("y"), exact(sxx + 2 * a * sx + n * a * a).alias("xx"),
        exact(sxy + a * sy + b * sx + n * a * b).alias("xy"), exact(syy + 2 * b * sy + n * b * b).alias("yy"))
    slope, intercept, r2 = _line(F.col("n_packets").cast("decimal(18,0)"), *[F.col(c) for c in ("x", "y", "xx", "xy", "yy")])
    return moved.select("node", "n_packets", (slope / 1_000_000).alias("slope"), (intercept / 1_000_000).alias("intercept"), r2.alias("r2"),
                        from_us("island_us", is_ntz(packets, "ts")).alias("first_ts"))


def stall_report(packets: DataFrame, timeout: timedelta, now: datetime | Column, tie: str = "event_id", **kw) -> DataFrame:
    """Packets followed by a silence over the timeout; ``open`` where it lasts until ``now``."""
    timed = ordered.with_next_time(packets.withColumn("_us", us("ts")), KEY, "_us", ["_us", tie], tie=tie, **kw)
    end = F.coalesce("next_us", us(instant(now, type_of(packets, "ts"))))
    out = timed.withColumn("silent_us", end - F.col("_us")).withColumn("open", F.col("next_us").isNull())
    return out.where(F.col("silent_us") > micros(timeout)).drop("_us", "next_us")
