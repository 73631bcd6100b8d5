"""Which intervals cover a point, as an equi-join on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions.times import MINUTE, slot_number

BASE = MINUTE
GROWTH = 8
LEVELS = 8    # the widest buckets span 8**7 minutes, about four years
SPAN = 4      # an interval may be this many buckets long before it moves to wider ones


def _level(length: Column, base: int) -> Column:
    """Narrowest bucket level at which an interval spans at most ``SPAN`` widths."""
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(length <= SPAN * base * GROWTH ** level, level).otherwise(out)
    return out


def _bucket(time_us: Column, level: Column, base: int) -> Column:
    out = slot_number(time_us, base * GROWTH ** (LEVELS - 1))
    for level_no in reversed(range(LEVELS - 1)):
        out = F.when(level == level_no, slot_number(time_us, base * GROWTH ** level_no)).otherwise(out)
    return out


def stab_join(intervals: DataFrame, points: DataFrame, start_us: str, end_us: str, point_us: str,
              base: int = BASE, keys: dict[str, str] | None = None) -> DataFrame:
    """Pairs with ``start < point <= end`` and, where ``keys`` are given, equal keys (interval's to point's).

    An interval goes to the bucket width that suits its length and is repeated for the few
    buckets it touches, whatever its length; a point is repeated once per level that occurs, which is looked up
    first. The exact test follows the equi-join, so no pair is lost or doubled.
    """
    level = _level(F.col(end_us) - F.col(start_us), base)
    spread = (intervals.where(F.col(end_us) > F.col(start_us)).withColumn("_level", level)
              .withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start_us), F.col("_level"), base),
                                                          _bucket(F.col(end_us), F.col("_level"), base)))))
    levels = sorted(r[0] for r in intervals.where(F.col(end_us) > F.col(start_us)).select(level).distinct().collect())  # at most LEVELS
    asked = (points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels or [0]])))
             .withColumn("_bucket", _bucket(F.col(point_us), F.col("_level"), base)))
    spread, asked = spread.withColumnRenamed("_level", "_at").withColumnRenamed("_bucket", "_in"), asked
    on = (F.col("_at") == F.col("_level")) & (F.col("_in") == F.col("_bucket"))
    for mine, other in (keys or {}).items():
        on = on & (F.col(mine) == F.col(other))
    return (spread.join(asked, on).drop("_at", "_in")
            .where((F.col(point_us) > F.col(start_us)) & (F.col(point_us) <= F.col(end_us)))
            .drop("_level", "_bucket"))
