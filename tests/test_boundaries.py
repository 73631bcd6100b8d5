"""Hand-made rows at the edges of the rules."""

import random
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from segtide.functions import names, routing, signal
from segtide.operators import capture, catalog, nodes, playlist, playout, resample, schedule, segments, uploads
from segtide.plans import delayed_playout
from segtide.sources import layout
from segtide.sources.listing import listing_extract
from tests.conftest import at

NOW = at("2024-01-16T00:00:00")
DELAY, SEGMENT = timedelta(hours=24), timedelta(hours=6)
FILES = "node bigint, file_time timestamp_ntz, filepath string, duration_s double"


def files(rows, *ages: timedelta, duration: float = 600.0):
    return rows([(1, NOW - age, f"f{i}", duration) for i, age in enumerate(ages)], FILES)


def column(df, name):
    return [r[name] for r in df.orderBy("filepath").collect()]


def test_both_ends_of_the_age_window_are_open(rows):
    tick = timedelta(microseconds=1)
    df = files(rows, DELAY, DELAY - tick, DELAY - SEGMENT + tick, DELAY - SEGMENT)
    assert column(catalog.eligible_files(df, NOW, DELAY, SEGMENT), "filepath") == ["f1", "f2"]


def test_queue_states_at_their_edges(rows):
    tick, length = timedelta(microseconds=1), timedelta(seconds=600)
    df = files(rows, DELAY, DELAY + tick, DELAY + length, DELAY + length + tick)
    assert column(catalog.queue_state(df, NOW, DELAY), "state") == ["pending", "playing", "playing", "expired"]


def test_every_entry_is_classified(rows):
    df = files(rows, *[DELAY + timedelta(hours=1)] * 5)
    got = catalog.run_counters(df, NOW, DELAY, SEGMENT).first()
    assert (got.listed, got.played, got.deleted) == (5, 0, 5)


def test_eligible_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "file_time")
    plan = catalog.eligible_files(df, NOW, DELAY, SEGMENT)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "LessThan(ts" in plan


@pytest.mark.parametrize("name, parsed", [
    ("P-2021-01-09T00:15:00.000015.x", "2021-01-09T00:15:00.000015"),
    ("P-P-2021-01-09T00:15:00.x.x", "2021-01-09T00:15:00"),
    ("2021-01-09T00:15:00", "2021-01-09T00:15:00"),
    ("P-2024.x", None), ("P-2021-02-30T00:00:00.x", None), ("P-2021-01-09T00:15:00Z.x", None), ("", None)])
def test_file_times(rows, name, parsed):
    got = rows([(name,)], "n string").select(names.parse_file_time(F.col("n"), "P-", ".x")).first()[0]
    assert got == (at(parsed) if parsed else None)


def test_bad_names_are_quarantined(rows):
    good, bad = catalog.build_catalog(rows([("u", "P-2021-01-09T00:15:00.x"), ("u", "readme")],
                                           "url string, filepath string"), "P-", ".x")
    assert good.count() == 1 and [r.filepath for r in bad.collect()] == ["readme"]


def test_listing_text_nodes(rows):
    html = "a MARK<p>one MARK</p><!-- <b>MARK</b> -->x > MARK<br><i title='MARK'>no</i>MARK tail"
    got = listing_extract(rows([(1, "u", html), (2, "u", ""), (3, "u", None)],
                               "page_id bigint, url string, html string"), "MARK")
    # the text before the first tag and after the last one is not between two tags
    assert [r.node_text for r in got.collect()] == ["one MARK", "x > MARK"]


def test_names_of_one_second_collide(rows):
    df = rows([("a-2021-01-09T00:15:00.000015.mseed",), ("a-2021-01-09T00:15:00.900000.mseed",),
               ("a-2021-01-09T00:15:01.000000.mseed",), ("short",)], "filepath string")
    got = {r.filepath: (r.ts_name, r.name_collision) for r in names.derive_names(df).collect()}
    assert got["a-2021-01-09T00:15:00.000015.mseed"] == ("a-2021-01-09T00-15-00.ts", True)
    assert got["a-2021-01-09T00:15:01.000000.mseed"] == ("a-2021-01-09T00-15-01.ts", False)
    assert got["short"] == ("ts", False)


def test_live_names_grow(rows):
    df = rows([(7,), (1234,)], "i bigint").select(names.live_name(F.col("i")))
    assert [r[0] for r in df.collect()] == ["live007.ts", "live1234.ts"]


def test_object_keys(rows):
    df = rows([("/tmp/n/hls/1/", "a.ts"), ("/tmp/n", "b"), ("/tmpx/n", "c")], "p string, f string")
    got = [r[0] for r in df.select(names.object_key(F.col("p"), F.col("f"))).collect()]
    assert got == ["n/hls/1/a.ts", "n/b", "/tmpx/n/c"]


def test_buckets(rows):
    df = rows([("prod",), ("custom",), ("other",), ("",), (None,)], "bucket_type string").withColumn("kind", F.lit("hls"))
    got = routing.with_bucket(df, {"hls": routing.Buckets("p", "d", "c")}).collect()
    assert [(r.bucket, r.unrouted) for r in got] == [("p", False), ("c", False), ("d", False), ("d", False), ("", True)]


def test_unset_is_not_empty(rows):
    schema = ", ".join(f"{c} string" for c in (*routing.REQUIRED, *routing.WARNED))
    df = routing.config_check(rows([("",) * 9, (None, "1", None, *("x",) * 5, None)], schema)).collect()
    assert df[0].passes and df[0].missing == [] and df[0].warnings == []
    assert not df[1].passes and df[1].missing == ["node_name", "audio_hw_id"] and df[1].warnings == ["flac_duration"]


def test_file_events(rows):
    data = [(["IN_CLOSE_WRITE"], "a.ts"), (["IN_CLOSE_WRITE"], "a.tmp"), (["IN_MOVED_TO"], "b.tmp"),
            (["X", "IN_MOVED_TO"], "c"), ([], "d"), (None, "e"), (["IN_CLOSE_WRITE"], None)]
    got = uploads.file_event_filter(rows(data, "types array<string>, filename string"))
    assert [r.filename for r in got.collect()] == ["a.ts", "b.tmp"]


def test_schedule_is_half_open(rows):
    df = rows([(at("2024-01-01T00:00:00"), at("2024-01-01T00:10:00")), (at("2024-01-01T00:00:00"), at("2024-01-01T00:00:00")),
               (at("2024-01-01T01:00:00"), at("2024-01-01T01:07:00"))], "start timestamp_ntz, end timestamp_ntz")
    got = schedule.segment_schedule(df, timedelta(minutes=5)).orderBy("seg_start").collect()
    assert [(r.seg_start.minute, r.seg_end.minute) for r in got] == [(0, 5), (5, 10), (0, 5), (5, 7)]


def test_listing_days_fill_long_delays(rows):
    df = rows([(at("2024-03-01T01:00:00"), timedelta(hours=50))], "now timestamp_ntz, delay interval day to second")
    got = [r.day_path for r in schedule.plan_listing_days(df, "b/").orderBy("day").collect()]
    assert got == ["b/2024/02/27", "b/2024/02/28", "b/2024/02/29", "b/2024/03/01"]


def test_existing_and_missing_segments_do_not_stop_the_schedule(rows):
    df = rows([(1, at(f"2024-01-01T0{h}:00:00"), at(f"2024-01-01T0{h + 1}:00:00"), str(h)) for h in range(4)],
              "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz, name string")
    todo = schedule.skip_existing(df, df.where("name = '0'"), on=("node", "name"))
    samples = rows([(1, at("2024-01-01T02:30:00"))], "node bigint, ts timestamp_ntz")
    missing = schedule.missing_segments(todo, samples)
    assert sorted(r.name for r in missing.collect()) == ["1", "3"]


def test_overlapping_ranges_give_each_segment_once(rows):
    df = rows([(1, at("2024-01-02T00:30:00")), (1, at("2024-01-02T00:45:00"))], "node bigint, now timestamp_ntz")
    got = schedule.near_and_backfill(df, timedelta(hours=1)).orderBy("seg_start").collect()
    assert len(got) == len({r.seg_start for r in got}) == 25
    assert [r.origin for r in got] == ["backfill"] * 16 + ["near"] * 9
    assert got[-1].seg_end == at("2024-01-02T00:45:00")


def test_playlist_and_append(rows):
    data = [(1, at("2024-01-01T00:00:00"), at("2024-01-01T00:05:00"), "a.ts"),
            (1, at("2024-01-01T00:05:00"), at("2024-01-01T00:07:00.500000"), "b.ts")]
    df = rows(data + data[:1], "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz, ts_name string")
    body = playlist.build_playlist(df, ["node"]).first().body
    assert body.split("\n") == ["#EXTM3U", "#EXT-X-TARGETDURATION:300", "#EXTINF:300.000000,", "a.ts",
                                "#EXTINF:120.500000,", "b.ts", "#EXT-X-ENDLIST"]
    first = playlist.build_playlist(df.where("ts_name = 'a.ts'"), ["node"])
    assert playlist.append_playlist(first, df.where("ts_name = 'b.ts'"), ["node"]).first().body == body
    assert playlist.append_playlist(first, df.where("false"), ["node"]).first().body == first.first().body
    assert playlist.append_playlist(first.where("false"), df, ["node"]).first().body == body


def test_backfill_may_move_the_pointer_back(rows):
    df = rows([(1, 20, at("2024-01-01T00:00:00")), (1, 10, at("2024-01-01T01:00:00"))],
              "node bigint, run_id bigint, written_at timestamp_ntz")
    assert playlist.latest_pointer(df).first().run_id == 10


PACKETS = "node bigint, ts timestamp_ntz, event_id bigint, value double"


def test_gap_must_be_strictly_longer(rows):
    data = [(1, at("2024-01-01T00:00:00"), 0, 1.0), (1, at("2024-01-01T00:30:00"), 1, 1.0),
            (1, at("2024-01-01T01:00:00.000001"), 2, 1.0)]
    df = rows(data, PACKETS)
    gap = timedelta(minutes=30)
    assert [r.xrun for r in capture.xrun_flags(df, gap).orderBy("event_id").collect()] == [False, False, True]
    assert sorted(r.n_packets for r in capture.reset_islands(df, gap).collect()) == [1, 2]
    stalls = capture.stall_report(df, gap, at("2024-01-01T01:30:00.000001")).collect()
    assert [(r.event_id, r.open) for r in stalls] == [(1, False)]


def test_run_segments_count_from_the_run(rows):
    runs = rows([(1, at("2024-01-01T00:00:07"))], "node bigint, started_at timestamp_ntz")
    data = [(1, at(f"2024-01-01T00:00:{s:02d}"), s, 1.0) for s in (6, 7, 16, 17)]
    got = segments.run_segments(rows(data, PACKETS), runs, timedelta(seconds=10)).orderBy("seg_index").collect()
    assert [(r.seg_index, r.n_samples, r.seg_start.second) for r in got] == [(0, 2, 7), (1, 1, 17)]


def test_one_slot_plays_the_latest(rows):
    data = [(1, NOW - DELAY, "a", 600.0), (1, NOW - DELAY + timedelta(minutes=5), "b", 600.0)]
    ticks = rows([(NOW,), (NOW + timedelta(minutes=5),), (NOW + timedelta(minutes=6),), (NOW + timedelta(minutes=15),)],
                 "tick timestamp_ntz")
    playing = playout.playing_at(rows(data, FILES), ticks, DELAY)
    # the start itself is still pending, the end still plays
    assert sorted((r.tick.minute, r.filepath) for r in playing.collect()) == [(5, "a"), (6, "a"), (6, "b"), (15, "b")]
    assert {r.tick.minute: r.filepath for r in playout.on_air_top1(playing).collect()} == {5: "a", 6: "b", 15: "b"}


def test_loop_and_timeline(rows):
    items = rows([("l", 1, "a", 2.0), ("l", 2, "b", 3.0)], "list_id string, pos bigint, file string, duration_s double")
    looped = playout.loop_expand(items, 3)
    got = playout.concat_timeline(looped, width=2).orderBy("pos").collect()
    assert [(r.pos, r.file, r.offset_s) for r in got] == [
        (0, "a", 0.0), (1, "b", 2.0), (2, "a", 5.0), (3, "b", 7.0), (4, "a", 10.0), (5, "b", 12.0)]


def test_earliest_attempt_stays(rows):
    one, two = [rows([(f, s)], "filepath string, size bigint") for f, s in (("a", 9), ("a", 1))]
    got = playout.accumulate_converted([one, two, one]).first()
    assert (got.size, got.attempt) == (9, 0)


@pytest.mark.parametrize("n", [2, 1500])
def test_conversion_order_small_and_large(rows, n):
    df = rows([(k, NOW + timedelta(minutes=i), f"{i:05d}", 1.0) for k in (1, 2) for i in range(1600)], FILES)
    got = catalog.conversion_order(df, n)
    assert got.count() == 2 * n
    assert all(int(r.filepath) == r["rank"] - 1 for r in got.collect())


def test_next_available(rows):
    df = files(rows, timedelta(hours=25), timedelta(hours=20), timedelta(hours=10))
    ticks = rows([(NOW,)], "tick timestamp_ntz")
    done = df.where("filepath = 'f1'").select("filepath")
    none = df.where("false").select("filepath")
    assert catalog.next_available(df, ticks, none, DELAY, SEGMENT).count() == 0  # f1 is eligible
    got = catalog.next_available(df, ticks, done, DELAY, SEGMENT).first()
    assert got.wait_us == -2 * 3_600_000_000  # the done file is named, with a negative wait
    got = catalog.next_available(df.where("filepath = 'f0'"), ticks, none, DELAY, SEGMENT).first()
    assert got.next_us is None and got.wait_us is None


def test_resampling(rows):
    df = rows([(1, at("2024-01-01T00:00:01"), 0, 0.0), (1, at("2024-01-01T00:00:05"), 1, 8.0),
               (1, at("2024-01-01T00:00:06"), 2, 1.0)], PACKETS)
    up = resample.resample_up(df, timedelta(seconds=2)).orderBy("slot").collect()
    assert [(r.slot.second, r.value) for r in up] == [(2, 2.0), (4, 6.0), (6, 1.0)]
    down = resample.resample_down(df, timedelta(seconds=4)).orderBy("slot").collect()
    assert [(r.slot.second, r.value) for r in down] == [(0, 0.0), (4, 4.5)]


def test_gap_fill_puts_zero(rows):
    segs = rows([(1, at("2024-01-01T00:00:00"), at("2024-01-01T00:00:03"))],
                "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz")
    df = rows([(1, at("2024-01-01T00:00:00"), 0, 1.0), (1, at("2024-01-01T00:00:02"), 1, 3.0)], PACKETS)
    got = resample.gap_fill(df, segs, timedelta(seconds=1)).orderBy("slot").collect()
    assert [r.value for r in got] == [-1.0, 0.0, 1.0]


def test_signal_arrays(rows):
    df = rows([([1.0, 2.0], [10.0, 20.0])], "a array<double>, b array<double>")
    got = df.select(signal.interleave(F.col("a"), F.col("b")).alias("i"), signal.downmix(F.col("a"), F.col("b")).alias("d"),
                    signal.gain(F.col("a")).alias("g")).first()
    assert (got.i, got.d, got.g) == ([1.0, 10.0, 2.0, 20.0], [5.5, 11.0], [1e4, 2e4])


def test_node_kinds_and_support(spark, rows):
    df = rows([("a", "arm32v7", "research"), ("b", "amd64", "research"), ("c", "amd64", "debug")],
              "node_name string, node_arch string, node_type string")
    out = nodes.node_outputs(df, nodes.output_kinds(spark))
    assert sorted((r.node_name, r.kind or "") for r in out.collect()) == [
        ("a", "flac"), ("a", "hls"), ("b", "flac"), ("b", "hls"), ("c", "")]
    yes, no = nodes.support_check(df, nodes.support_matrix(spark))
    assert [r.node_name for r in yes.collect()] == ["a"] and sorted(r.node_name for r in no.collect()) == ["b", "c"]


def test_no_loops_give_no_rows(rows):
    items = rows([("l", 1, "a", 2.0)], "list_id string, pos bigint, file string, duration_s double")
    assert playout.loop_expand(items, 0).count() == 0


def test_small_limits_are_cut_before_the_shuffle(rows):
    plan = catalog.conversion_order(files(rows, DELAY), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_names_and_copies(rows):
    """A third of the rows share one name, one file, one node: results stay whole."""
    data = [(1, NOW, "hot-2024-01-16T00:00:00.000000.mseed", 1.0)] * 200
    data += [(i % 5, NOW, f"f{i}-2024-01-16T00:00:00.000000.mseed", 1.0) for i in range(400)]
    df = rows(data, FILES)
    named = names.derive_names(df)
    assert named.count() == 600 and named.where("name_collision").count() == 200
    assert catalog.anti_done(df, df.where("filepath like 'hot%'").select("filepath")).count() == 400
    assert playout.accumulate_converted([df, df]).count() == 401


SEGMENTS = "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz"


def test_samples_count_inside_the_segment_only(rows):
    segs = rows([(1, at("2024-01-01T10:00:00"), at("2024-01-01T10:30:00")), (1, at("2024-01-01T10:07:00"), at("2024-01-01T11:07:00")),
                 (2, at("2024-01-01T10:07:00"), at("2024-01-01T11:07:00"))], SEGMENTS)
    samples = rows([(1, at("2024-01-01T10:50:00")), (1, at("2024-01-01T11:03:00")), (1, at("2024-01-01T11:07:00")),
                    (None, at("2024-01-01T10:20:00"))], "node bigint, ts timestamp_ntz")
    got = schedule.with_sample_counts(segs, samples)
    assert sorted((r.node, r.seg_start.minute, r.n_samples) for r in got.collect()) == [(1, 0, 0), (1, 7, 2), (2, 7, 0)]
    assert schedule.missing_segments(segs, samples).count() == 2


def test_gap_fill_counts_slots_from_the_segment(rows):
    segs = rows([(1, at("2024-01-01T00:07:00"), at("2024-01-01T00:37:00"))], SEGMENTS)
    df = rows([(1, at("2024-01-01T00:08:00"), 0, 1.0), (1, at("2024-01-01T00:20:00"), 1, 2.0), (1, at("2024-01-01T00:36:00"), 2, 6.0),
               (1, at("2024-01-01T00:37:00"), 3, 99.0)], PACKETS)
    got = resample.gap_fill(df, segs, timedelta(minutes=10)).orderBy("slot").collect()
    assert [(r.slot.minute, r.value) for r in got] == [(7, -2.0), (17, -1.0), (27, 3.0)]


def test_loops_keep_the_order_over_gaps(rows):
    items = rows([("l", p, f, 1.0) for p, f in ((1, "a"), (5, "b"), (9, "c"))], "list_id string, pos bigint, file string, duration_s double")
    got = playout.loop_expand(items, 2).orderBy("pos").collect()
    assert [(r.pos, r.file) for r in got] == [(0, "a"), (4, "b"), (8, "c"), (9, "a"), (13, "b"), (17, "c")]


def test_next_available_of_each_node(rows):
    df = rows([(1, NOW - timedelta(hours=20), "a", 1.0), (2, NOW - timedelta(hours=10), "b", 1.0)], FILES)
    ticks = rows([(1, NOW), (2, NOW), (3, NOW)], "node bigint, tick timestamp_ntz")
    none = df.where("false").select("filepath")
    got = catalog.next_available(df, ticks, none, DELAY, SEGMENT, by=["node"]).collect()
    assert sorted((r.node, r.next_us is not None) for r in got) == [(2, True), (3, False)]


def test_next_available_at_every_tick_of_every_node(spark):
    import bisect

    from workbench.queries import QUERIES
    from workbench.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    done = {r.filepath for r in t.done().collect()}
    every, free = {}, {}
    for r in t.catalog().orderBy("file_time").collect():
        every.setdefault(r.node, []).append(r.file_time)
        free.setdefault(r.node, [])
        if r.filepath not in done:
            free[r.node].append(r.file_time)
    wanted = set()
    for tick in (r.tick for r in t.ticks().collect()):
        for node in every:
            k = bisect.bisect_right(free[node], tick - timedelta(hours=24))
            if k == len(free[node]) or free[node][k] >= tick - timedelta(hours=18):
                k = bisect.bisect_right(every[node], tick - timedelta(hours=24))
                wanted.add((node, tick, every[node][k] if k < len(every[node]) else None))
    got = [(r.node, r.tick, r.next_time) for r in QUERIES["next_available"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert {g[0] for g in got} == set(every) and any(g[1].minute for g in got)


def test_append_adds_each_segment_once_and_raises_the_target(rows):
    data = [(1, at("2024-01-01T00:00:00"), at("2024-01-01T00:00:10"), "a.ts"), (1, at("2024-01-01T00:00:10"), at("2024-01-01T00:01:10"), "b.ts")]
    df = rows(data, "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz, ts_name string")
    first = playlist.build_playlist(df.where("ts_name = 'a.ts'"), ["node"])
    assert playlist.append_playlist(first, df, ["node"]).first().body.split("\n") == [
        "#EXTM3U", "#EXT-X-TARGETDURATION:60", "#EXTINF:10.000000,", "a.ts", "#EXTINF:60.000000,", "b.ts", "#EXT-X-ENDLIST"]


def test_overlapping_and_touching_segments_share_samples(rows):
    """Every sample counts in each segment that holds it, whatever bounds cross; also where chunks are cut."""
    draw = random.Random(11)
    t0 = at("2024-01-01T00:00:00")
    times = [t0 + timedelta(seconds=draw.randrange(0, 7200)) for _ in range(300)] + [t0 + timedelta(seconds=600)] * 40
    samples = [(draw.choice([1, 1, 1, 2, None]), t, float(i)) for i, t in enumerate(times)]
    spans = []
    for _ in range(60):
        start = t0 + timedelta(seconds=draw.choice([0, 600, 1200, draw.randrange(-3000, 9000)]))
        spans.append((draw.choice([1, 2, 3]), start, start + timedelta(seconds=draw.choice([0, 1, 600, 3600, 20_000]))))
    spans = sorted(set(spans + spans[:5]))
    want = {s: sum(n == s[0] and s[1] <= t < s[2] for n, t, _ in samples) for s in spans}
    segs = rows(spans, "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz").repartition(3)
    df = rows(samples, "node bigint, ts timestamp_ntz, value double").repartition(4)
    for max_rows in (9, 1_000_000):
        got = schedule.with_sample_counts(segs, df, max_rows=max_rows).collect()
        assert {(r.node, r.seg_start, r.seg_end): r.n_samples for r in got} == want
    filled = resample.gap_fill(df, segs.where("seg_end > seg_start"), timedelta(seconds=500), max_rows=9).collect()
    for r in filled:
        inside = [v for n, t, v in samples if n == r.node and r.slot <= t < r.slot + timedelta(seconds=500)]
        if not inside:
            assert r.value == 0.0
    one = next(s for s in spans if s[2] - s[1] == timedelta(seconds=20_000) and want[s])
    mine = [v for n, t, v in samples if n == one[0] and one[1] <= t < one[2]]
    slot = [v for n, t, v in samples if n == one[0] and one[1] <= t < one[1] + timedelta(seconds=500)]
    first = [r.value for r in filled if (r.node, r.segment, r.slot) == (one[0], one[1], one[1])]
    expected = sum(slot) / len(slot) - sum(mine) / len(mine) if slot else 0.0
    assert any(abs(v - expected) < 1e-9 for v in first)


def test_no_segments_and_no_samples(rows):
    none = rows([], "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz")
    one = rows([(1, at("2024-01-01T00:00:00"), at("2024-01-01T01:00:00"))], "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz")
    samples = rows([(1, at("2024-01-01T00:10:00"), 1.0)], "node bigint, ts timestamp_ntz, value double")
    assert schedule.with_sample_counts(none, samples).count() == 0
    assert [r.n_samples for r in schedule.with_sample_counts(one, samples.where("node = 2")).collect()] == [0]


def test_planned_days_prune_the_scan(spark, rows, tmp_path):
    """Days of the plan are found at run time; folders of other days stay unread."""
    files = rows([(f"f{d}", at(f"2024-01-{d:02d}T12:00:00")) for d in range(1, 29)], "filepath string, file_time timestamp_ntz")
    path = layout.write_days(files, str(tmp_path / "days"))
    asked = rows([(at("2024-01-10T01:00:00"), timedelta(hours=30)), (at("2024-01-20T00:00:00"), timedelta(hours=1))],
                 "now timestamp_ntz, delay interval day to second")
    got = layout.scan_planned_days(spark, path, schedule.plan_listing_days(asked, "archive"), "filepath string, file_time timestamp_ntz, day string")
    assert sorted(r.filepath for r in got.collect()) == ["f10", "f19", "f20", "f8", "f9"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan.lower()
    for day in ("2024-01-01", "2024-01-28"):  # what isn't read may be gone by the time of the query
        shutil.rmtree(f"{path}/day={day}")
    listed = delayed_playout.listed_names(spark, path, at("2024-01-10T01:00:00"), timedelta(hours=30), "filepath string, file_time timestamp_ntz, day string")
    assert sorted(r.filepath for r in listed.collect()) == ["f10", "f8", "f9"]


@pytest.mark.parametrize("name, scans", [("asof_run", 3), ("xrun_flags", 2), ("reset_islands", 3), ("stall_report", 2), ("clock_fit", 3),
                                         ("concat_timeline", 2), ("resample_up", 2), ("next_available", 3), ("live_to_store", 8)])
def test_plans_read_their_inputs_once_after_the_summary(spark, name, scans):
    """The start plan has one scan of each input and one of each written summary, and broadcasts nothing by force."""
    from workbench.queries import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Scan parquet") <= scans and "strategy=broadcast" not in plan
