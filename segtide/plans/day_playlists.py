"""Requests for recent data to one playlist per node and day."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from segtide.functions.names import segment_names
from segtide.operators.playlist import build_playlist
from segtide.operators.schedule import near_and_backfill, skip_existing, with_sample_counts
from segtide.sources.written import written


def day_playlists(requests: DataFrame, present: DataFrame, samples: DataFrame, length: timedelta,
                  prefix: str) -> DataFrame:
    """Schedule, skip what is stored, leave out what has no data, name, and list per day.

    The segments to fetch are written once; the samples are read in their times only.
    """
    wanted = segment_names(near_and_backfill(requests, length), prefix)
    todo, _ = written(skip_existing(wanted, present), "todo")
    fetched = with_sample_counts(todo, samples).where("n_samples > 0")
    return build_playlist(fetched, ["node", "subdir"])
