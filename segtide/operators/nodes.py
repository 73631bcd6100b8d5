"""The node registry: what a node produces, and whether its kind of machine supports it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segtide.operators.keys import per_key

# Outputs by node type, and the support matrix of architectures and types.
OUTPUT_KINDS = [("research", "flac"), ("research", "hls"), ("hls-only", "hls"), ("dev-virt-s3", "hls")]
SUPPORT = [("arm32v7", "hls-only", True), ("arm32v7", "research", True), ("arm32v7", "dev-virt-s3", False),
           ("amd64", "hls-only", True), ("amd64", "research", False), ("amd64", "dev-virt-s3", True)]


def output_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTPUT_KINDS, "node_type string, kind string")


def support_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUPPORT, "node_arch string, node_type string, supported boolean")


def node_outputs(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per node and kind of output; types without any keep one row with a null kind.

    No broadcast is forced: Spark broadcasts the table of kinds while it is small.
    """
    return nodes.join(kinds.distinct(), "node_type", "left")


def support_check(nodes: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose architecture supports their type, and the others."""
    on = ["node_arch", "node_type"]
    yes = per_key(support.where("supported"), on)
    return nodes.join(yes, on, "left_semi"), nodes.join(yes, on, "left_anti")
