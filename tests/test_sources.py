"""Layouts, sample payloads and the shared folder."""

import random
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segtide.operators import catalog, schedule
from segtide.operators.intervals import stab_join
from segtide.session import shared_dir
from segtide.sources import layout, pcm
from tests.conftest import at

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_only_asked_days_are_read(spark, rows, tmp_path):
    df = rows([(1, at(f"2024-01-{d:02d}T03:00:00"), f"f{d}") for d in range(1, 6)],
              "node bigint, file_time timestamp_ntz, filepath string")
    path = layout.write_days(df, str(tmp_path / "days"))
    got = layout.scan_days(spark, path, ["2024-01-02", "2024-01-04"], "filepath string, day string")
    assert sorted(r.filepath for r in got.collect()) == ["f2", "f4"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan


def test_payload_files_round_trip(spark, rows, tmp_path):
    rnd = random.Random(3)
    data = [(i, [rnd.uniform(-1.2, 1.2) for _ in range(i)]) for i in range(5)]
    wavs = pcm.pcm_write(rows(data, "seg_id bigint, samples array<float>"), "seg_id", "samples", 8000).collect()
    folder = tmp_path / "wav"
    folder.mkdir()
    for r in wavs:
        (folder / f"{r.path}.wav").write_bytes(bytes(r.content))
    (folder / "bad.wav").write_bytes(b"RIFF")
    (folder / "cut.wav").write_bytes(bytes(wavs[4].content)[:-1])
    (folder / "other.wav").write_bytes(b"x" * 60)
    good, bad = pcm.pcm_read(spark.read.format("binaryFile").load(str(folder)))
    got = {int(r.path.rsplit("/", 1)[1][:-4]): r for r in good.collect()}
    for i, samples in data:
        want = np.clip(np.floor(np.asarray(samples, dtype="float32").astype("float64") * 32767 + 0.5), -32768, 32767) / 32767
        assert np.allclose(got[i].samples, want, atol=1e-7) and got[i].rate == 8000
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.wav", "cut.wav", "other.wav"]


def test_shared_dir_reads_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    if not before:
        spark.conf.set("spark.checkpoint.dir", "hdfs:///scratch")
        assert shared_dir(spark, "x").startswith("hdfs:///scratch/x-")
        spark.conf.unset("spark.checkpoint.dir")


@FEW
@given(st.lists(st.tuples(st.integers(0, 3_000_000), st.integers(1, 20_000)), min_size=1, max_size=5),
       st.integers(7, 900))
def test_schedules_cover_their_range(spark, ranges, minutes):
    t0 = at("2024-01-01T00:00:00")
    data = [(i, t0 + timedelta(seconds=s), t0 + timedelta(seconds=s + n)) for i, (s, n) in enumerate(ranges)]
    df = spark.createDataFrame(data, "id bigint, start timestamp_ntz, end timestamp_ntz")
    got = schedule.segment_schedule(df, timedelta(minutes=minutes)).orderBy("id", "seg_start").collect()
    for i, start, end in data:
        mine = [r for r in got if r.id == i]
        assert mine[0].seg_start == start and mine[-1].seg_end == end
        assert all(a.seg_end == b.seg_start for a, b in zip(mine, mine[1:]))


def test_long_schedules_use_several_blocks(rows):
    df = rows([(at("2024-01-01T00:00:00"), at("2024-01-01T03:00:00.5"))], "start timestamp_ntz, end timestamp_ntz")
    got = schedule.segment_schedule(df, timedelta(seconds=1))
    assert got.count() == got.select("seg_start").distinct().count() == 10_801


@pytest.mark.parametrize("base", [1_000, 60_000_000])
def test_stab_join_equals_the_nested_loop(spark, base):
    rnd = random.Random(5)
    spans = []
    for i in range(300):
        start = rnd.randrange(-10**9, 10**9)
        spans.append((i, start, start + rnd.choice([0, 1, 10, 10**4, 10**6, 10**8, 10**13, -5])))
    points = [(rnd.choice([s, e, s + 1, (s + e) // 2]),) for _, s, e in spans] + [(0,), (-1,)]
    left = spark.createDataFrame(spans, "id bigint, a bigint, b bigint")
    right = spark.createDataFrame(points, "p bigint").distinct()
    got = stab_join(left, right, "a", "b", "p", base=base).select("id", "p").collect()
    want = {(i, p) for i, a, b in spans for (p,) in set(points) if a < p <= b}
    assert len(got) == len(want) and {(r.id, r.p) for r in got} == want


def test_anti_done_twice_is_once(spark, rows):
    df = rows([(f"f{i % 7}",) for i in range(30)], "filepath string")
    done = df.where("filepath in ('f1', 'f2')")
    once = catalog.anti_done(df, done)
    assert once.count() == catalog.anti_done(once, done).count() == df.where(~F.col("filepath").isin("f1", "f2")).count()
