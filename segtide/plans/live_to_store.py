"""Live samples of configured nodes to the keys of their stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.functions.names import archive_name, live_name, object_key
from segtide.functions.routing import Buckets, apply_type_overrides, config_check, with_bucket
from segtide.operators.keys import per_key
from segtide.operators.nodes import node_outputs, support_check
from segtide.operators.segments import asof_run, cut_runs


def live_to_store(nodes: DataFrame, samples: DataFrame, runs: DataFrame, kinds: DataFrame, support: DataFrame,
                  routes: dict[str, Buckets]) -> DataFrame:
    """One row per file: valid and supported nodes, their outputs, segments of each run, names, keys, buckets.

    Segments are as long as the node's ``segment_duration`` and, in the archive, ``flac_duration`` (seconds); a node
    without the latter has no archive. Samples and runs of other nodes are left out first; the others are tied to runs
    once and cut to segments before they meet the outputs.
    """
    valid, _ = support_check(apply_type_overrides(config_check(nodes).where("passes")), support)
    wanted = node_outputs(valid, kinds).where("kind is not null").select(
        "node", "node_name", "kind", "bucket_type", "sample_rate", "channels")
    lengths = per_key(valid, ["node"], *[(F.max(c).cast("bigint") * 1_000_000).alias(u) for c, u in (
        ("segment_duration", "live_us"), ("flac_duration", "archive_us"))])
    tied = asof_run(samples.join(lengths, "node"), runs.join(lengths.select("node"), "node", "left_semi"))
    files = cut_runs(tied, {"hls": "live_us", "flac": "archive_us"}).join(wanted, ["node", "kind"])
    hls = F.col("kind") == "hls"
    folder = F.concat(F.lit("/tmp/"), "node_name", F.lit("/"), "kind",
                      F.when(hls, F.concat(F.lit("/"), F.col("run_id").cast("string"))).otherwise(""))
    name = F.when(hls, live_name(F.col("seg_index"))).otherwise(
        archive_name(F.col("seg_start"), F.col("node_name"), F.col("sample_rate"), F.col("channels")))
    keyed = (files.withColumn("file_name", name)
             .withColumn("object_key", object_key(folder, F.col("file_name"))))
    return with_bucket(keyed, routes).select(
        "node_name", "kind", "run_id", "file_name", "object_key", "bucket", "n_samples")
