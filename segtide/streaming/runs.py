"""Segments counted from the start of a run, on live streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from segtide.functions.times import micros, us

# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
STATE = "waiting binary, starts binary, newest bigint, open binary"
SEGMENTS = "node bigint, run_start_us bigint, seg_index bigint, n_samples bigint, first_us bigint, last_us bigint"
NONE = -(1 << 63)


class RunCutter(StatefulProcessor):
    """One node: samples wait until the watermark has passed them, as a run may still come that began before them; then
    they join the newest run's segment, and a segment is given out when the watermark has passed its end.

    The state holds the waiting times, the starts not yet passed, the newest start passed and the open segments; what is done is
    forgotten. Each node has one timer, for whatever is due first.
    """

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("cuts", STATE)

    def _get(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        row = self.state.get() if self.state.exists() else (b"", b"", NONE, b"")
        return (np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), row[2], np.frombuffer(row[3], np.int64).reshape(-1, 5))

    def _keep(self, waiting: np.ndarray, starts: np.ndarray, newest: int, open_: np.ndarray) -> None:
        self.state.update((waiting.tobytes(), starts.tobytes(), int(newest), np.ascontiguousarray(open_).tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        due = [int(x.min()) for x in (waiting, starts) if len(x)] + [int(v) for v in open_[:, 0] + (open_[:, 1] + 1) * self.length]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, starts, newest, open_ = self._get()
        for pdf in rows:
            times, is_start = pdf["at_us"].to_numpy(np.int64), pdf["is_start"].to_numpy(bool)
            waiting, starts = np.concatenate([waiting, times[~is_start]]), np.concatenate([starts, times[is_start]])
        self._keep(waiting, starts, newest, open_)
        yield pd.DataFrame({"node": [], "run_start_us": [], "seg_index": [], "n_samples": [], "first_us": [], "last_us": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, starts, newest, open_ = self._get()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = np.sort(starts[starts <= mark])
        known = np.unique(np.concatenate([[newest], passed]))
        times = np.sort(waiting[waiting <= mark])
        run = known[np.searchsorted(known, times, "right") - 1]
        times, run = times[run != NONE], run[run != NONE]
        cuts = np.stack([run, (times - run) // self.length, np.ones_like(times), times, times], axis=1)
        merged: dict[tuple, list] = {}
        for start, index, n, first, last in np.concatenate([open_, cuts]).tolist():
            held = merged.setdefault((start, index), [0, first, last])
            held[:] = [held[0] + n, min(held[1], first), max(held[2], last)]
        table = np.array([[*k, *v] for k, v in merged.items()], dtype=np.int64).reshape(-1, 5)
        done = table[:, 0] + (table[:, 1] + 1) * self.length <= mark
        self._keep(waiting[waiting > mark], starts[starts > mark], known[-1], table[~done])
        out = table[done]
        yield pd.DataFrame({"node": np.full(len(out), key[0], dtype="int64"), **{
            c: out[:, i] for i, c in enumerate(("run_start_us", "seg_index", "n_samples", "first_us", "last_us"))}})

    def close(self) -> None:
        pass


def stream_run_segments(samples: DataFrame, runs: DataFrame, length: timedelta, lateness: timedelta) -> DataFrame:
    """``run_segments`` on live streams of samples (``node, ts``) and run starts (``node, started_at``), both at most ``lateness``
    late: one row per segment, once the watermark has passed its end, equal to the batch form.

    Rows without a node or a time, and samples before their node's first run, are in no segment.
    """
    def timed(rows: DataFrame, ts: str, is_start: bool) -> DataFrame:
        return rows.select("node", F.col(ts).cast("timestamp").alias("ts"), F.lit(is_start).alias("is_start"))

    both = timed(samples, "ts", False).unionByName(timed(runs, "started_at", True)).where("node is not null and ts is not null")
    marked = both.withWatermark("ts", f"{micros(lateness) // 1000} milliseconds")
    keyed = marked.select("node", "ts", us("ts").alias("at_us"), "is_start").groupBy("node")
    cut = keyed.transformWithStateInPandas(RunCutter(micros(length)), T._parse_datatype_string(SEGMENTS), "append", "eventTime")
    start = F.col("run_start_us") + F.col("seg_index") * F.lit(micros(length))
    return cut.select("node", "run_start_us", F.call_function("div", F.col("run_start_us"), F.lit(1_000_000)).alias("run_id"), "seg_index",
                      "n_samples", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"),
                      F.timestamp_micros(start).alias("seg_start"))
