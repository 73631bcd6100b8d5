"""The file catalogue: building it, choosing files by age, and queue states.

Ages are taken against ``now`` with a fixed play-out delay: a file is eligible while its age lies
strictly between ``delay - segment`` and ``delay``, and it plays from ``delay`` to ``delay`` plus
its own duration.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.functions.names import parse_file_time
from segtide.functions.times import instant, micros, type_of, us
from segtide.operators import ordered
from segtide.operators.keys import per_key
from segtide.sources.written import written


LEDGER_BITS = 1 << 24  # of a ledger's filter: 4 MB of rows


def build_catalog(names: DataFrame, prefix: str, postfix: str) -> tuple[DataFrame, DataFrame]:
    """Split rows with a ``filepath`` into catalogue rows and a quarantine of unreadable names."""
    timed = names.withColumn("file_time", parse_file_time(F.col("filepath"), prefix, postfix))
    return timed.where("file_time is not null"), timed.where("file_time is null").drop("file_time")


def _window(files: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta):
    now = instant(now, type_of(files, "file_time"))
    return now - F.lit(delay), now - F.lit(delay - segment)


def is_eligible(files: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta) -> Column:
    """Age test written on the bare ``file_time`` column, so that it reaches the scan."""
    oldest, newest = _window(files, now, delay, segment)
    return (F.col("file_time") > oldest) & (F.col("file_time") < newest)


def eligible_files(files: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta) -> DataFrame:
    return files.where(is_eligible(files, now, delay, segment))


def _probes(path: str, size: int) -> list[Column]:
    """Two places of a path in a filter of ``size`` bits."""
    h = F.xxhash64(F.col(path))
    return [F.pmod(h, F.lit(size)), F.pmod(F.shiftright(h, 32), F.lit(size))]


def ledger_filter(done: DataFrame, size: int = LEDGER_BITS) -> DataFrame:
    """A Bloom filter of the ledger's paths, written: ``_word`` (64 bits each), ``_bits``. It has ``size`` / 64 rows at most, whatever the
    ledger's length; about a tenth of it in paths lets one new file in thirty through to the exact test."""
    places = done.select(F.explode(F.array(*_probes("filepath", size))).alias("_place"))
    word, bit = F.call_function("div", F.col("_place"), F.lit(64)), (F.col("_place") % 64).cast("int")
    return written(places.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits")),
                   "ledger_bits")[0]


def anti_done(files: DataFrame, done: DataFrame, bits: DataFrame | None = None, size: int = LEDGER_BITS) -> DataFrame:
    """Drop files that are in the ledger.

    The ledger is first cut to one row per path; a path with very many catalogue copies is
    split by the adaptive skew join. With ``bits`` (``ledger_filter`` of the ledger, of the same ``size``) files that are surely new aren't
    shuffled at all: only those that may be in the ledger meet it. The filter's size is bounded, so it is broadcast.
    """
    ledger = per_key(done, ["filepath"])
    if bits is None:
        return files.join(ledger, "filepath", "left_anti")
    marked, both = files, F.lit(True)
    for i, place in enumerate(_probes("filepath", size)):
        words = F.broadcast(bits.select(F.col("_word").alias(f"_word{i}"), F.col("_bits").alias(f"_bits{i}")))
        marked = marked.withColumn(f"_word{i}", F.call_function("div", place, F.lit(64))).join(words, f"_word{i}", "left")
        bit = F.call_function("shiftright", F.col(f"_bits{i}"), (place % 64).cast("int")).bitwiseAND(F.lit(1))
        both = both & (F.coalesce(bit, F.lit(0)) == 1)
    new = marked.where(~both).select(files.columns)
    return new.unionByName(marked.where(both).select(files.columns).join(ledger, "filepath", "left_anti"))


def queue_state_of(files: DataFrame, now: datetime | Column, delay: timedelta) -> Column:
    age = us(instant(now, type_of(files, "file_time"))) - us("file_time")
    past_delay = age - F.lit(micros(delay))
    length = (F.col("duration_s") * 1_000_000).cast("bigint")
    return (F.when(past_delay > length, "expired").when(past_delay > 0, "playing").otherwise("pending"))


def queue_state(files: DataFrame, now: datetime | Column, delay: timedelta) -> DataFrame:
    """Add ``state``: ``expired``, ``playing`` or ``pending``."""
    return files.withColumn("state", queue_state_of(files, now, delay))


def run_counters(files: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta,
                 by: list[str] | None = None) -> DataFrame:
    """Counts of one pass, in one scan; a played file counts as deleted too."""
    state = queue_state_of(files, now, delay)
    return files.groupBy(*(by or [])).agg(
        F.count("*").alias("listed"),
        F.count_if(is_eligible(files, now, delay, segment)).alias("to_convert"),
        F.count_if(state == "playing").alias("played"),
        F.count_if(state.isin("playing", "expired")).alias("deleted"))


def conversion_order(files: DataFrame, n: int, tie: str = "filepath") -> DataFrame:
    """The first ``n`` files of every node in time order, with their ``rank``.

    Every task cuts a node down to ``n`` rows before the shuffle (window group limit, which ``configure``
    allows for any ``n``), so what meets in one task is bounded by ``n`` and the number of tasks.
    """
    order = W.partitionBy("node").orderBy("file_time", tie)
    return files.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def next_available(files: DataFrame, ticks: DataFrame, done: DataFrame, delay: timedelta,
                   segment: timedelta, by: list[str] | None = None, **kw) -> DataFrame:
    """For every tick without an eligible file: the earliest file not yet too old, and the wait.

    With ``by`` (columns of both files and ticks, such as the node) every key is asked for by itself.
    Files in the ledger are not eligible, but the earliest file is looked up among all of them,
    so the wait can be negative. Both look-ups are forward as-of searches. Only distinct file
    times matter, so copies are merged first and written; ticks and times then meet in time chunks, and
    each chunk is handed the first time of the chunks after it (see ``ordered``).
    """
    by = by or []
    flagged = files.select(*by, "file_time", "filepath").distinct().join(
        per_key(done, ["filepath"]).withColumn("_done", F.lit(True)), "filepath", "left")
    times = (flagged.groupBy(*by, us("file_time").alias("_us"))
             .agg(F.min(F.coalesce("_done", F.lit(False))).alias("_all_done"))
             .select(*by, "_us", F.col("_us").alias("_any"), F.when(~F.col("_all_done"), F.col("_us")).alias("_open")))
    asked = ticks.select(*by, "tick", (us("tick") - micros(delay)).alias("_us"))
    both = asked.unionByName(written(times, "file_times")[0], allowMissingColumns=True)
    c = ordered.scanned(both, by, "_us", ordered.least("_a", "_any") | ordered.least("_o", "_open"),
                        after={"_later_any": F.min("_a"), "_later_open": F.min("_o")}, **kw)
    # strictly later times only; descending, so that the frame grows
    ahead = ordered.chunk_window(by, F.desc("_us")).rangeBetween(W.unboundedPreceding, -1)
    found = (c.withColumn("_next", F.coalesce(F.min("_any").over(ahead), F.col("_later_any")))
             .withColumn("_next_open", F.coalesce(F.min("_open").over(ahead), F.col("_later_open")))
             .where("tick is not null"))
    found = ordered.unchunk(found, by)
    newest = us("tick") - micros(delay - segment)
    idle = found.where(F.col("_next_open").isNull() | (F.col("_next_open") >= newest))
    return idle.select(*by, "tick", F.col("_next").alias("next_us"), (F.col("_next") - newest).alias("wait_us"))
