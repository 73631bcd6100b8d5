"""Sample arrays. Samples stay in their arrays; nothing here explodes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain(samples: Column, factor: float = 1e4) -> Column:
    return F.transform(samples, lambda x: x * F.lit(float(factor)))


def _frames(channels: list[Column], combine) -> Column:
    """One element per frame, made from the samples of all channels at that frame."""
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(channels)])
    return F.transform(zipped, lambda z: combine([z[f"c{i}"] for i in range(len(channels))]))


def interleave(*channels: Column) -> Column:
    """Planar channels to interleaved frames: all channels of frame 0, then of frame 1, ..."""
    return F.flatten(_frames(list(channels), lambda parts: F.array(*parts)))


def downmix(*channels: Column) -> Column:
    """Mean of the channels in every frame."""
    return _frames(list(channels), lambda parts: reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts))))


def cycle_time(now_s: Column, cycle_delay: Column, rate: Column) -> Column:
    """Start of the device cycle, in seconds."""
    return now_s - cycle_delay.cast("double") / rate


def packet_pts(now_s: Column, cycle_delay: Column, rate: Column, latencies: Column) -> Column:
    """Packet time in microseconds: cycle start less the mean port latency, fraction cut."""
    total = F.aggregate(latencies, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    ports = F.size(latencies)
    start = cycle_time(now_s, cycle_delay, rate)
    return ((start - total.cast("double") / (ports * rate)) * F.lit(1_000_000.0)).cast("bigint")
