"""Catalogue streams: polling, the ledger of done files, late files, and counters."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segtide.functions.times import micros, us
from segtide.operators.catalog import build_catalog, eligible_files, run_counters
from segtide.sources.sinks import batch_sink, tee_sinks, write_batch
from segtide.sources.state import StateTable

REMEMBERED = 100_000
POLL = "150 seconds"  # fixed value: polls keep this phase, however long a pass takes


def stream_poll_catalog(listing: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta,
                        prefix: str, postfix: str) -> DataFrame:
    """Names of every listing snapshot to eligible catalogue rows.

    ``now`` is the poll time: a column of the snapshot, or ``current_timestamp()``, which is
    fixed per batch. A file that is too young in one snapshot is looked at again in the next;
    ``stream_dedup_done`` behind this passes each file once.
    """
    good, _ = build_catalog(listing, prefix, postfix)
    return eligible_files(good, now, delay, segment)


def stream_bad_names(listing: DataFrame, prefix: str, postfix: str) -> DataFrame:
    """The names of every snapshot that ``stream_poll_catalog`` can't read, for a sink of their own."""
    return build_catalog(listing, prefix, postfix)[1]


def _first_copies(catalog: DataFrame) -> DataFrame:
    """Drop copies of a file that one task sees, before anything is shuffled; a task remembers so many paths."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = []
            for path in batch.column("filepath").to_pylist():
                keep.append(path not in seen)
                seen.add(path)
            yield batch.filter(pa.array(keep, pa.bool_()))
            if len(seen) > REMEMBERED:
                seen.clear()

    return catalog.mapInArrow(work, catalog.schema)


def poll_sinks(listing: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta, prefix: str, postfix: str, files: str,
               bad_names: str, checkpoint: str, every: str | None = POLL) -> StreamingQuery:
    """The poll as it runs: every 150 s on a fixed phase, eligible files to one folder and names that can't be read to another; each
    listing is parsed once. Without ``every`` it takes what is there and ends."""
    outputs = {"files": (lambda batch: stream_poll_catalog(batch, now, delay, segment, prefix, postfix), files),
               "bad": (lambda batch: stream_bad_names(batch, prefix, postfix), bad_names)}
    return tee_sinks(listing, outputs, checkpoint, every)


def stream_dedup_done(catalog: DataFrame, delay: timedelta) -> DataFrame:
    """Pass each file once; a file is forgotten when the watermark is past its play-out time.

    Copies in one task are dropped before the shuffle to the state, so a file with very many copies sends a few
    rows of each task, not all of them to one.
    """
    timed = _first_copies(catalog.withColumn("file_time", F.col("file_time").cast("timestamp")))
    return (timed.withWatermark("file_time", f"{micros(delay) // 1000} milliseconds")
            .dropDuplicatesWithinWatermark(["filepath"]))


def stream_late_drop(catalog: DataFrame, maxdelay: timedelta, kept: str, late: str, state: str,
                     checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Split off files that are ``maxdelay`` or more behind the newest file time seen so far, and those
    without a file time.

    The newest time is a one-row table of snapshots and changes (``StateTable``); a repeated batch starts
    from the state its first try saw.
    """
    table = StateTable(catalog.sparkSession, state, "high_us bigint", lambda rows: rows.agg(F.max("high_us").alias("high_us")))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.update(batch_id, batch.select(us("file_time").alias("high_us")))
            high = table.read(batch_id + 1).first()["high_us"]  # one row
            is_late = F.coalesce(us("file_time") <= F.lit(high) - micros(maxdelay), F.lit(True))
            write_batch(batch.where(~is_late), kept, batch_id)
            write_batch(batch.where(is_late), late, batch_id)
        finally:
            batch.unpersist()

    return batch_sink(catalog, each, checkpoint, every=every)


def stream_counters(catalog: DataFrame, now: datetime | Column, delay: timedelta, segment: timedelta,
                    path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The counts of every pass as a table with one row per batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(run_counters(batch, now, delay, segment), path, batch_id)

    return batch_sink(catalog, each, checkpoint, every=every)
