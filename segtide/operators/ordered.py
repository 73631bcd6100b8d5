"""Ordered work on long streams without one task per stream.

A window over ``partition by node order by time`` puts a whole node into one task. Here a node's time is cut into
buckets, and one read of the rows sums up the slots of every bucket: a small written table. Scans along a node run
over that table: they cut buckets with too many rows into parts, and tell every chunk (bucket and part) what it must
know of the chunks before or after it. A second read shuffles the rows by chunk, once, and windows run inside a chunk.

Key columns are replaced by never-null stand-ins while rows are chunked, and restored by ``unchunk``:
rows without a key form a stream of their own.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.functions.times import HOUR, micros, slot_number, slot_start
from segtide.sources.written import written

FINE = 256            # slots of a bucket
LOWEST = -(1 << 63)   # before every tie
TIE_STEPS = 4         # steps of a crowded slot's ties for each part it fills


def _stands(keys: list[str]) -> list[str]:
    return [f"_key_{k}" for k in keys]


def _any_value(kind: T.DataType) -> Column:
    """Some value of a type, to stand for null beside a null mark."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    text = "0" if isinstance(kind, (T.NumericType, T.BooleanType)) else "1970-01-01"
    return F.lit(text).cast(kind)


def chunk_columns(keys: list[str]) -> list[str]:
    return [*_stands(keys), "_nulls", "_bucket", "_part"]


def _bucketed(df: DataFrame, keys: list[str], time_us: str, width: int) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)],
                   F.lit(0))
    solid = [F.coalesce(F.col(k), _any_value(df.schema[k].dataType)).alias(s) for k, s in zip(keys, _stands(keys))]
    return df.select(*[F.col(c) for c in df.columns if c not in keys], *solid, nulls.cast("bigint").alias("_nulls"),
                     slot_number(F.col(time_us), width).alias("_bucket"))


def _slots(rows: DataFrame, group: list[str], time_us: str, fine: int, tie: str | None, max_rows: int,
           figures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows, ties and figures of every slot: one read. Only slots that are too full by themselves are read again, instant by
    instant, and an instant in steps of its ties."""
    ties = F.col(tie) if tie else F.lit(LOWEST)
    sums = [F.count("*").alias("_n"), F.min(ties).alias("_low"), F.max(ties).alias("_high"),
            *[of_rows.alias(name) for name, (of_rows, _) in figures.items()]]
    slot = slot_start(F.col(time_us), fine)
    slots, seen = written(rows.groupBy(*group, slot.alias("_from")).agg(*sums)
                          .withColumn("_from_tie", F.lit(LOWEST)), "slots", most=F.max("_n"))
    if (seen["most"] or 0) <= max_rows:
        return slots
    steps = F.call_function("div", F.col("_n") * TIE_STEPS, F.lit(max_rows)) + 1
    crowded = slots.where(F.col("_n") > max_rows).select(
        *group, F.col("_from").alias("_slot"), F.col("_low").alias("_least"),
        (F.call_function("div", F.try_subtract("_high", "_low"), steps) + 1).alias("_step"))
    # null ties, and ties too far apart for whole numbers, stay in one piece
    begin = ties - F.pmod(F.try_subtract(ties, F.col("_least")), F.col("_step"))
    inside = rows.withColumn("_slot", slot).join(crowded, [*group, "_slot"])
    finer = inside.groupBy(*group, F.col(time_us).alias("_from"), F.coalesce(begin, F.lit(LOWEST)).alias("_from_tie")).agg(*sums)
    return slots.where(F.col("_n") <= max_rows).unionByName(finer)


def scanned(df: DataFrame, keys: list[str], time_us: str, figures: dict[str, tuple[Column, Column]],
            before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
            width: timedelta | int = HOUR, tie: str | None = None, max_rows: int = 5_000_000) -> DataFrame:
    """The rows in chunks, each row with what the chunks before and after its own hand it.

    ``figures`` names aggregates of rows and how those of slots combine, as (over rows, over slots): they must combine
    partially. ``before`` and ``after`` aggregate them over all earlier or later chunks of the key. A bucket (of
    ``width``) is cut where a part has ``max_rows`` rows; an instant with more than that is cut by
    the whole number ``tie``, which must follow the time in the order of the rows.

    The slots are written, then the chunks with the carried values; the scan along a key sees one row per chunk. Where
    buckets are cut, rows find their part by a join on the bucket with the few parts of cut buckets, whose written
    size Spark knows. Both happen when this is called; reading the result reads the source once more.
    """
    width = micros(width)
    group = [*_stands(keys), "_nulls", "_bucket"]
    rows = _bucketed(df, keys, time_us, width)
    slots = _slots(rows, group, time_us, max(width // FINE, 1), tie, max_rows, figures)
    in_bucket = W.partitionBy(*group).orderBy("_from", "_from_tie").rowsBetween(W.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_n").over(in_bucket), F.lit(0))
    chunks = (slots.withColumn("_part", F.call_function("div", filled, F.lit(max_rows))).groupBy(*group, "_part")
              .agg(F.min(F.struct("_from", "_from_tie")).alias("_begin"),
                   *[of_slots.alias(name) for name, (_, of_slots) in figures.items()]))
    key = W.partitionBy(*_stands(keys), "_nulls")
    # growing frames in both directions: a shrinking frame is recomputed for every row
    earlier = key.orderBy("_bucket", "_part").rowsBetween(W.unboundedPreceding, -1)
    later = key.orderBy(F.desc("_bucket"), F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    in_order = key.orderBy("_bucket", "_part")
    end = F.when(F.lead("_bucket").over(in_order) == F.col("_bucket"), F.lead("_begin").over(in_order))
    carried, seen = written(chunks.select(
        *group, "_part", "_begin", end.alias("_end"), *[c.over(earlier).alias(n) for n, c in (before or {}).items()],
        *[c.over(later).alias(n) for n, c in (after or {}).items()]), "chunks", last=F.max("_part"))
    if seen["last"]:
        parts = carried.where("_part > 0").select(
            *[F.col(c).alias(f"{c}_of") for c in group], "_part", *[F.col(f"_{side}.{c}").alias(f"_{side}{c}") for side in ("begin", "end")
                                                                   for c in ("_from", "_from_tie")])
        at, ties = F.col(time_us), F.coalesce(F.col(tie), F.lit(LOWEST)) if tie else F.lit(LOWEST)

        def reached(side: str) -> Column:
            return (at > F.col(f"_{side}_from")) | ((at == F.col(f"_{side}_from")) & (ties >= F.col(f"_{side}_from_tie")))

        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_of") for c in group])
        inside = reached("begin") & (F.col("_end_from").isNull() | ~reached("end"))
        rows = rows.join(parts, same & inside, "left").select(*rows.columns, F.coalesce("_part", F.lit(0)).alias("_part"))
    else:
        rows = rows.withColumn("_part", F.lit(0).cast("bigint"))
    if not before and not after:
        return rows
    # both sides are hashed by chunk, which is the layout the windows inside a chunk need: one shuffle for both
    handed = carried.select(*chunk_columns(keys), *(before or {}), *(after or {}))
    return rows.join(handed.hint("shuffle_hash"), chunk_columns(keys), "left")


def unchunk(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Put the key columns back, in front."""
    back = [F.when(F.col("_nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(s)).alias(k)
            for i, (k, s) in enumerate(zip(keys, _stands(keys)))]
    return chunked.select(*back, *[c for c in chunked.columns if c not in chunk_columns(keys)])


def chunk_window(keys: list[str], *order: Column | str) -> W:
    return W.partitionBy(*chunk_columns(keys)).orderBy(*order)


def greatest(name: str, of: Column | str) -> dict[str, tuple[Column, Column]]:
    return {name: (F.max(of), F.max(name))}


def least(name: str, of: Column | str) -> dict[str, tuple[Column, Column]]:
    return {name: (F.min(of), F.min(name))}


def total(name: str, aggregate: Column) -> dict[str, tuple[Column, Column]]:
    return {name: (aggregate, F.sum(name))}


def with_previous_time(df: DataFrame, keys: list[str], time_us: str, order: list[str], **kw) -> DataFrame:
    """Add ``prev_us``: the time of the row before, across chunks."""
    c = scanned(df, keys, time_us, greatest("_tail", time_us), before={"_before": F.max("_tail")}, **kw)
    local = F.lag(time_us).over(chunk_window(keys, *order))
    return unchunk(c.withColumn("prev_us", F.coalesce(local, F.col("_before"))).drop("_before"), keys)


def with_next_time(df: DataFrame, keys: list[str], time_us: str, order: list[str], **kw) -> DataFrame:
    """Add ``next_us``: the time of the row after, across chunks."""
    c = scanned(df, keys, time_us, least("_head", time_us), after={"_after": F.min("_head")}, **kw)
    local = F.lead(time_us).over(chunk_window(keys, *order))
    return unchunk(c.withColumn("next_us", F.coalesce(local, F.col("_after"))).drop("_after"), keys)


def with_rank(df: DataFrame, keys: list[str], time_us: str, order: list[str], **kw) -> DataFrame:
    """Add ``rank``: position of the row in its key's order, from 1."""
    c = scanned(df, keys, time_us, total("_rows", F.count("*")), before={"_offset": F.sum("_rows")}, **kw)
    local = F.row_number().over(chunk_window(keys, *order))
    return unchunk(c.withColumn("rank", local + F.coalesce("_offset", F.lit(0))).drop("_offset"), keys)


def with_running_sum(df: DataFrame, keys: list[str], time_us: str, order: list[str], value: Column, out: str, **kw) -> DataFrame:
    """Add ``out``: sum of ``value`` over all earlier rows of the key (0 for the first).

    Values are whole numbers or decimals, so that the sum doesn't depend on where a stream is cut.
    """
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError("sum whole numbers or decimals: the sum of doubles depends on their order")
    c = scanned(df.withColumn("_value", value), keys, time_us, total("_sum", F.sum("_value")), before={"_offset": F.sum("_sum")}, **kw)
    local = F.sum("_value").over(chunk_window(keys, *order).rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0)
    return unchunk(c.withColumn(out, F.coalesce(local, zero) + F.coalesce("_offset", zero)).drop("_offset", "_value"), keys)
