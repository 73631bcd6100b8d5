"""Where a node's files go, and whether its settings are complete."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Settings a node must have, one it may lack with a warning, and the rates
# and channels that some node types force.
REQUIRED = ("node_name", "sample_rate", "audio_hw_id", "channels", "node_type", "stream_rate",
            "segment_duration", "node_arch")
WARNED = ("flac_duration",)
VIRTUAL_TYPE, VIRTUAL_RATE = "dev-virt-s3", 48000
RESEARCH_TYPE, RESEARCH_LIVE_CHANNELS = "research", 2


@dataclass(frozen=True)
class Buckets:
    """Bucket names of one kind of output; ``custom`` may be a column of the node's row."""

    prod: str
    dev: str
    custom: str


def bucket_route(bucket_type: Column, kind: Column, routes: dict[str, Buckets]) -> Column:
    """Bucket by type and kind; the empty string where no type is set."""
    out = None
    for name, buckets in routes.items():
        choice = (F.when(bucket_type.isNull(), "")
                  .when(bucket_type == "prod", buckets.prod)
                  .when(bucket_type == "custom", buckets.custom)
                  .otherwise(buckets.dev))
        out = F.when(kind == name, choice) if out is None else out.when(kind == name, choice)
    return F.coalesce(out, F.lit(""))


def with_bucket(files: DataFrame, routes: dict[str, Buckets]) -> DataFrame:
    """Add ``bucket`` and the ``unrouted`` flag to rows with ``bucket_type`` and ``kind``."""
    return (files.withColumn("bucket", bucket_route(F.col("bucket_type"), F.col("kind"), routes))
            .withColumn("unrouted", F.col("bucket") == ""))


def config_check(nodes: DataFrame) -> DataFrame:
    """Add ``missing`` (required settings that are unset), ``warnings`` and ``passes``.

    Unset means null: an empty string counts as set.
    """
    def unset(names):
        return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))

    return (nodes.withColumn("missing", unset(REQUIRED)).withColumn("warnings", unset(WARNED))
            .withColumn("passes", F.size("missing") == 0))


def apply_type_overrides(nodes: DataFrame) -> DataFrame:
    """Add the effective ``sample_rate``, ``stream_rate`` and ``live_channels``."""
    virtual = F.coalesce(F.col("node_type") == VIRTUAL_TYPE, F.lit(False))
    research = F.coalesce(F.col("node_type") == RESEARCH_TYPE, F.lit(False))
    return (nodes
            .withColumn("sample_rate", F.when(virtual, VIRTUAL_RATE).otherwise(F.col("sample_rate")))
            .withColumn("stream_rate", F.when(virtual, VIRTUAL_RATE).otherwise(F.col("stream_rate")))
            .withColumn("live_channels",
                        F.when(research, RESEARCH_LIVE_CHANNELS).otherwise(F.col("channels"))))
