"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings; all can be changed on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the first n rows of a key are cut out before the shuffle, whatever n is
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # session windows shuffle by node: merge each task's rows first
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _is_local(spark: SparkSession) -> bool:
    return (spark.conf.get("spark.master", "") or "").startswith("local")


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if "spark.sql.shuffle.partitions" not in spark.conf.getAll:
        # nobody has set it; the default is too many for one machine, too few for a large cluster, where the
        # adaptive planner can merge small partitions but not add any
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(cores if _is_local(spark) else max(200, 3 * cores)))
    return spark


def new_session(name: str = "segtide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="segtide-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder all executors can reach, below ``spark.checkpoint.dir``.

    Only a local master may fall back to this machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _local_base()
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
