"""Sound files of a watched tree, decoded as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segtide.sources.pcm import pcm_decode
from segtide.sources.sinks import tee_sinks


def stream_frames(files: DataFrame, frames: str, errors: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Decode a stream of files (``watch_files``): frames to one folder, files that can't be decoded to another, with
    the reason. Each file is decoded once."""
    decoded = pcm_decode(files)
    outputs = {"frames": (lambda batch: batch.where("error is null").drop("error"), frames),
               "errors": (lambda batch: batch.where(F.col("error").isNotNull()).select("path", "error"), errors)}
    return tee_sinks(decoded, outputs, checkpoint, every)
