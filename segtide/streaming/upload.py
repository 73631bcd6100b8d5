"""Finished files of a watched tree to their store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segtide.functions.routing import Buckets
from segtide.operators.uploads import routed_files
from segtide.sources.objects import move_sink


def upload_moves(events: DataFrame, routes: dict[str, Buckets], store: str, root: str = "/tmp") -> DataFrame:
    """``source`` and ``target`` of finished files: ``store/bucket/key``, and no target where no bucket is set."""
    target = F.concat_ws("/", F.lit(store.rstrip("/")), "bucket", "object_key")
    return routed_files(events, routes, root).select(
        F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/"), "filename").alias("source"), F.when(~F.col("unrouted"), target).alias("target"))


def stream_upload(events: DataFrame, routes: dict[str, Buckets], store: str, manifest: str, checkpoint: str,
                  root: str = "/tmp", every: str | None = None) -> StreamingQuery:
    """Move finished files to their bucket in ``store``. Files without a bucket, and those that fail, stay where they
    are and are reported in the manifest (``objects.moved``)."""
    return move_sink(upload_moves(events, routes, store, root), manifest, checkpoint, every)
