"""File events: which files are finished, and where they go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.names import object_key
from segtide.functions.routing import Buckets, with_bucket

# Kinds of file event, and the mark of an unfinished file.
CLOSED, MOVED, UNFINISHED = "IN_CLOSE_WRITE", "IN_MOVED_TO", "tmp"


def file_event_filter(events: DataFrame) -> DataFrame:
    """Closed files whose name is not marked unfinished, and any file moved in.

    Only the first type of an event counts; an event without one never passes.
    """
    first = F.get("types", F.lit(0))
    closed = (first == CLOSED) & ~F.contains(F.col("filename"), F.lit(UNFINISHED))
    return events.where(F.coalesce(closed | (first == MOVED), F.lit(False)))


def routed_files(events: DataFrame, routes: dict[str, Buckets], root: str = "/tmp") -> DataFrame:
    """Finished files with ``object_key``, ``bucket`` and ``unrouted``; needs ``bucket_type`` and ``kind``."""
    keyed = file_event_filter(events).withColumn("object_key", object_key(F.col("path"), F.col("filename"), root))
    return with_bucket(keyed, routes)
