"""Streams against their batch forms: several micro-batches, restarts, late rows, cleaning."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from segtide.functions.routing import Buckets
from segtide.operators import capture, segments
from segtide.sources import objects, pcm, sinks, state, tree
from segtide.streaming import frames, live, polls, queue, upload
from segtide.streaming import runs as runs_stream
from tests.conftest import at

PACKETS = "node bigint, ts timestamp_ntz, event_id bigint"
FILES = "node bigint, file_time timestamp_ntz, filepath string, duration_s double"
T0 = at("2024-01-01T00:00:00")


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows as the next file of a watched folder; read the folder as a stream."""
    class Feed:
        path, number = str(tmp_path / "in"), 0

        def put(self, data, schema):
            self.number += 1
            name = f"{self.path}/part{self.number % 2}/{self.number:03d}"
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(name)

        def stream(self, schema, **kw):
            return tree.watch_tree(spark, self.path, schema, files_per_trigger=1, **kw)

        def dir(self, name):
            return str(tmp_path / name)

    return Feed()


def packets(seed: int, n: int = 40):
    """In time order over three nodes, with gaps; one file per call."""
    return [(i % 3, T0 + timedelta(minutes=seed * 600 + i * 7 + (60 if i > 20 else 0)), seed * 1000 + i) for i in range(n)]


def drain(stream, feed, name):
    sinks.append_sink(stream, feed.dir(name), feed.dir(name + "-cp")).awaitTermination()


def test_segments_and_islands_over_batches_and_restarts(spark, feed):
    for seed in range(2):
        feed.put(packets(seed), PACKETS)
    hour, gap, late = timedelta(hours=1), timedelta(minutes=30), timedelta(minutes=10)
    def run():
        drain(live.stream_segments(feed.stream(PACKETS), hour, late), feed, "segments")
        drain(live.stream_islands(feed.stream(PACKETS), gap, late), feed, "islands")
    run()
    for seed in range(2, 4):
        feed.put(packets(seed), PACKETS)
    feed.put([(9, T0 + timedelta(days=9), 1)], PACKETS)  # moves the watermark past the rest
    run()  # goes on from the checkpoint
    whole = spark.read.option("recursiveFileLookup", "true").schema(PACKETS).parquet(feed.path).where("node < 9")
    for name, want, keys in (("segments", segments.clock_segments(whole, hour), ["node", "seg_start", "n_samples"]),
                             ("islands", capture.reset_islands(whole, gap), ["node", "first_ts", "n_packets"])):
        got = spark.read.parquet(feed.dir(name)).where("node < 9")
        flat = lambda d: sorted(tuple(map(str, r)) for r in d.select(*keys).collect())
        assert flat(got) == flat(want), name


def test_stall_alert_waits_for_the_timeout(spark, feed):
    feed.put([(1, T0, 0), (2, T0, 1), (2, T0 + timedelta(hours=3), 2)], PACKETS)
    alerts = live.stream_stall_alert(feed.stream(PACKETS), timedelta(hours=3), timedelta(0))
    drain(alerts, feed, "alerts")
    got = spark.read.parquet(feed.dir("alerts")).collect()
    # node 2 was silent for exactly the timeout, which is no stall yet
    assert [(r.node, r.silent_since) for r in got] == [(1, T0)]


def test_silent_node_alerts_by_heartbeat(spark, feed):
    """No packet comes any more; poll times alone move the watermark."""
    feed.put([(1, T0, 0)], PACKETS)
    path = feed.dir("beats")
    spark.createDataFrame([(T0 + timedelta(hours=5),)], "ts timestamp_ntz").write.parquet(path)
    beats = spark.readStream.schema("ts timestamp_ntz").parquet(path)
    drain(live.stream_stall_alert(feed.stream(PACKETS), timedelta(hours=3), timedelta(0), heartbeat=beats), feed, "silent")
    assert [(r.node, r.silent_since) for r in spark.read.parquet(feed.dir("silent")).collect()] == [(1, T0)]


def test_files_without_a_time_are_late(spark, feed):
    feed.put([(1, T0, "a", 1.0), (1, None, "b", 1.0)], FILES)
    polls.stream_late_drop(feed.stream(FILES), timedelta(hours=4), *[feed.dir(d) for d in ("k", "l", "h", "c")]).awaitTermination()
    kept, late = [sorted(r.filepath for r in sinks.read_batches(spark, feed.dir(d), "filepath string").collect()) for d in ("k", "l")]
    assert (kept, late) == (["a"], ["b"])


def test_queue_plays_and_expires_each_file_once(spark, feed):
    data = [(1, T0 + timedelta(hours=i), f"f{i}", 1800.0) for i in range(4)]
    feed.put(data[:2] + data[:1], FILES)
    feed.put(data[2:], FILES)
    stream = queue.stream_playout_queue(feed.stream(FILES), timedelta(hours=1), timedelta(0))
    drain(stream, feed, "queue")
    got = sorted((r.filepath, r.state, r.at) for r in spark.read.parquet(feed.dir("queue")).collect())
    assert got == [("f0", "expired", T0 + timedelta(minutes=90)), ("f0", "playing", T0 + timedelta(hours=1)),
                   ("f1", "expired", T0 + timedelta(minutes=150)), ("f1", "playing", T0 + timedelta(hours=2))]
    # f2 is exactly one delay old at the watermark: still pending


def test_done_files_pass_once_over_batches(spark, feed):
    data = [(1, T0 + timedelta(hours=i), f"f{i}", 1.0) for i in range(3)]
    for _ in range(3):
        feed.put(data, FILES)
    drain(polls.stream_dedup_done(feed.stream(FILES), timedelta(hours=24)), feed, "done")
    assert spark.read.parquet(feed.dir("done")).count() == 3


def test_late_files_are_kept_aside(spark, feed):
    feed.put([(1, T0, "a", 1.0), (1, T0 + timedelta(hours=5), "b", 1.0)], FILES)
    feed.put([(1, T0 + timedelta(hours=1), "c", 1.0), (1, T0 + timedelta(hours=4), "d", 1.0)], FILES)
    polls.stream_late_drop(feed.stream(FILES), timedelta(hours=4), *[feed.dir(d) for d in ("kept", "late", "high", "cp")]
                           ).awaitTermination()
    kept, late = [sorted(r.filepath for r in sinks.read_batches(spark, feed.dir(d), "filepath string").collect())
                  for d in ("kept", "late")]
    assert (kept, late) == (["b", "d"], ["a", "c"])  # exactly maxdelay behind is late


def test_poll_looks_again_at_young_files(spark, feed):
    schema = "polled_at timestamp_ntz, url string, filepath string"
    for hours in (0, 20, 30):
        feed.put([(T0 + timedelta(hours=hours), "u", "2024-01-01T00:00:00")], schema)
    stream = polls.stream_poll_catalog(feed.stream(schema), F.col("polled_at"), timedelta(hours=24),
                                       timedelta(hours=6), "P-", ".x")
    drain(stream, feed, "polled")
    assert [r.polled_at.hour for r in spark.read.parquet(feed.dir("polled")).collect()] == [20]


def test_latest_pointer_follows_the_writes(spark, feed):
    schema = "node bigint, run_id bigint, written_at timestamp_ntz"
    feed.put([(1, 10, T0), (2, 5, T0)], schema)
    feed.put([(1, 7, T0 + timedelta(hours=1))], schema)
    live.stream_latest_pointer(feed.stream(schema), feed.dir("latest"), feed.dir("cp")).awaitTermination()
    table = live.latest_pointers(spark, feed.dir("latest"))
    assert sorted(tuple(r)[:2] for r in table.read(before=1).collect()) == [(1, 10), (2, 5)]
    assert sorted(tuple(r)[:2] for r in table.read().collect()) == [(1, 7), (2, 5)]


def test_state_stays_flat_and_repeats_are_safe(spark, rows, tmp_path):
    """Folders don't pile up over many batches; a batch repeated after a snapshot, or after half a snapshot, changes nothing."""
    schema = "key bigint, n bigint"
    table = state.StateTable(spark, str(tmp_path / "t"), schema, lambda df: df.groupBy("key").agg(F.sum("n").alias("n")), every=3)
    assert table.read().count() == 0
    want, most = {}, 0
    for i in range(20):
        for key in (i % 4, 9):
            want[key] = want.get(key, 0) + i
        again = 2 if i % 3 == 2 or i == 7 else 1
        for _ in range(again):
            table.update(i, rows([(i % 4, i), (9, i)], schema))
            assert {r.key: r.n for r in table.read().collect()} == want
        most = max(most, sum(len(os.listdir(tmp_path / "t" / k)) for k in os.listdir(tmp_path / "t")))
    assert most <= 2 * 3 + 3
    for part in os.listdir(tmp_path / "t" / "snapshot" / "batch_id=17"):  # a snapshot that broke off
        if "_SUCCESS" in part:
            os.remove(tmp_path / "t" / "snapshot" / "batch_id=17" / part)
    assert {r.key: r.n for r in table.read().collect()} == want


def test_sound_files_become_frames_and_bad_ones_errors(spark, rows, files, feed):
    sound = pcm.pcm_write(rows([("1", [0.5, -0.5]), ("2", [0.0] * 4), ("3", [1.0])], "id string, s array<float>"), "id", "s", 8000)
    made = {r.path: bytes(r.content) for r in sound.collect()}

    def run():
        frames.stream_frames(tree.watch_files(spark, files.root, "*.wav", files_per_trigger=1), feed.dir("good"), feed.dir("bad"), feed.dir("cp")).awaitTermination()

    files.make("a/1.wav", made["1"])
    files.make("a/b/2.wav", made["2"][:-1])
    files.make("a/notes.txt", b"no sound")
    run()
    files.make("3.wav", made["3"])
    run()  # the first two aren't read again
    good = sinks.read_batches(spark, feed.dir("good"), "path string, rate int, samples array<float>").collect()
    assert sorted((os.path.basename(r.path), r.rate, len(r.samples)) for r in good) == [("1.wav", 8000, 2), ("3.wav", 8000, 1)]
    assert [(os.path.basename(r.path), r.error) for r in sinks.read_batches(spark, feed.dir("bad"), "path string, error string").collect()] == [("2.wav", "cut short")]


EVENTS = "types array<string>, path string, filename string, kind string, bucket_type string"


@pytest.fixture
def files(tmp_path):
    """Make small files in a tree; say what is in a tree."""
    class Files:
        root, store = str(tmp_path / "tree"), str(tmp_path / "store")

        def make(self, name, data=b"sound"):
            path = os.path.join(self.root, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)
            return path

        def there(self, root):
            found = {}
            for folder, _, names in os.walk(root):
                for n in names:
                    with open(os.path.join(folder, n), "rb") as f:
                        found[os.path.relpath(os.path.join(folder, n), root)] = f.read()
            return found

    return Files()


def test_upload_moves_objects_and_keeps_what_fails(spark, feed, files):
    def event(kind, name, bucket, data=b"sound"):
        files.make("n/hls/1/" + name, data)
        return ([kind], files.root + "/n/hls/1", name, "hls", bucket)

    def run():
        upload.stream_upload(feed.stream(EVENTS), {"hls": Buckets("p", "d", "c")}, files.store, feed.dir("manifest"), feed.dir("cp"),
                             root=files.root).awaitTermination()

    big = bytes(range(256)) * 80_000  # several pieces
    feed.put([event("IN_CLOSE_WRITE", "live000.ts", "prod", big), event("IN_CLOSE_WRITE", "live.m3u8.tmp", "prod"),
              event("IN_CREATE", "open.ts", "prod"), event("IN_MOVED_TO", "no-bucket.ts", None)], EVENTS)
    run()
    assert files.there(files.store) == {"p/n/hls/1/live000.ts": big}
    assert sorted(files.there(files.root)) == ["n/hls/1/live.m3u8.tmp", "n/hls/1/no-bucket.ts", "n/hls/1/open.ts"]
    os.makedirs(files.store, exist_ok=True)
    with open(files.store + "/d", "w") as f:  # a file where a bucket should be
        f.write("x")
    feed.put([event("IN_CLOSE_WRITE", "blocked.ts", "dev"), event("IN_CLOSE_WRITE", "empty.ts", "custom", b""),
              (["IN_CLOSE_WRITE"], files.root + "/n", "never-there.ts", "hls", "prod")], EVENTS)
    run()  # goes on from the checkpoint
    assert files.there(files.store) == {"p/n/hls/1/live000.ts": big, "c/n/hls/1/empty.ts": b"", "d": b"x"}
    assert "n/hls/1/blocked.ts" in files.there(files.root)
    got = {os.path.basename(r.source): (r.n_bytes, r.deleted, r.error is None) for r in objects.moved(spark, feed.dir("manifest")).collect()}
    assert got == {"live000.ts": (len(big), True, True), "no-bucket.ts": (None, False, False), "blocked.ts": (None, False, False),
                   "empty.ts": (0, True, True), "never-there.ts": (None, False, False)}


def test_a_batch_that_broke_off_is_finished_by_its_repetition(spark, rows, files, tmp_path):
    a, b = files.make("a", b"1"), files.make("b", b"22")
    moves = rows([(a, files.store + "/a"), (b, files.store + "/b"), (b, files.store + "/b"), (None, "x")], "source string, target string")
    copied = objects.copy_objects(moves).collect()
    assert sorted((r.n_bytes, r.error) for r in copied) == [(1, None), (2, None)] and len(files.there(files.root)) == 2
    os.remove(a)  # the first try deleted one source, and was lost before it said so
    for _ in range(2):
        objects.move_batch(moves, str(tmp_path / "manifest"), 3)
    assert files.there(files.store) == {"a": b"1", "b": b"22"} and files.there(files.root) == {}
    assert sorted((r.n_bytes, r.deleted) for r in objects.moved(spark, str(tmp_path / "manifest")).collect()) == [(1, True), (2, True)]


def test_no_source_goes_without_its_own_target(rows, files):
    a, b = files.make("a", b"1"), files.make("b", b"22")
    both = objects.copy_objects(rows([(a, files.store + "/t"), (b, files.store + "/t")], "source string, target string"))
    assert sorted((r.source, r.error is None) for r in both.collect()) == [(a, True), (b, False)]
    short = rows([(a, files.store + "/t", 9, None), (b, files.store + "/none", 2, None)], objects.COPIED)
    assert [r.deleted for r in objects.delete_sources(short).collect()] == [False, False] and len(files.there(files.root)) == 2


def test_files_of_any_kind_are_watched_and_listed(spark, files, feed):
    files.make("x/1.wav", b"abc")
    files.make("y/z/2.txt", b"z")
    files.make("y/z/empty.txt", b"")  # Spark's reader gives no row for it
    stream = tree.watch_files(spark, files.root, files_per_trigger=1).select("path", "length", F.col("content").cast("string").alias("content"))
    drain(stream, feed, "seen")
    want = [("x/1.wav", 3), ("y/z/2.txt", 1)]
    assert sorted((r.path.split("/tree/")[1], r.length) for r in spark.read.parquet(feed.dir("seen")).collect()) == want
    for root in (files.root, "file://" + files.root, "file:" + files.root + "/"):
        assert sorted((r.path, r.length) for r in objects.list_objects(spark, root).collect()) == want


def test_copies_of_a_file_are_dropped_before_the_shuffle(spark, feed):
    hot = [(1, T0, "hot", 1.0)] * 5000 + [(1, T0 + timedelta(minutes=i), f"f{i}", 1.0) for i in range(20)] + [(1, T0, None, 1.0)] * 3
    feed.put(hot, FILES)
    feed.put(hot[4990:], FILES)
    query = sinks.append_sink(polls.stream_dedup_done(feed.stream(FILES), timedelta(days=1)), feed.dir("once"), feed.dir("cp"))
    query.awaitTermination()
    got = [r.filepath for r in spark.read.parquet(feed.dir("once")).collect()]
    assert sorted(got, key=str) == sorted(["hot", None] + [f"f{i}" for i in range(20)], key=str)
    updated = [o["numRowsTotal"] + o["customMetrics"].get("numDroppedDuplicateRows", 0) for p in query.recentProgress for o in p["stateOperators"]]
    assert max(updated) < 100  # the state saw a few rows, not thousands


def test_polls_keep_both_outputs(spark, feed):
    schema = "url string, filepath string"
    feed.put([("u", "2024-01-01T00:00:00"), ("u", "no name"), ("u", "2024-01-01T20:00:00")], schema)
    feed.put([("u", None), ("u", "2024-01-01T01:00:00")], schema)
    polls.poll_sinks(feed.stream(schema), T0 + timedelta(hours=20), timedelta(hours=24), timedelta(hours=6), "", "", feed.dir("files"), feed.dir("bad"),
                     feed.dir("cp"), every=None).awaitTermination()
    names = lambda d: sorted((r.filepath for r in sinks.read_batches(spark, feed.dir(d), "filepath string").collect()), key=str)
    assert names("files") == ["2024-01-01T00:00:00", "2024-01-01T01:00:00"] and names("bad") == [None, "no name"]


def test_run_segments_of_streams_are_those_of_tables(spark, feed, tmp_path):
    """Runs that begin while samples come, starts that arrive after their samples, over restarts."""
    starts = "node bigint, started_at timestamp_ntz"
    length, late = timedelta(minutes=50), timedelta(hours=3)
    draw, sent, begun = random.Random(4), [], []

    def run():
        runs = spark.readStream.schema(starts).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
        drain(runs_stream.stream_run_segments(feed.stream(PACKETS), runs, length, late), feed, "cut")

    for part in range(4):
        t0 = T0 + timedelta(hours=4 * part)
        some = [(draw.choice([1, 1, 1, 2, 3]), t0 + timedelta(seconds=draw.randrange(4 * 3600)), part * 1000 + i) for i in range(120)]
        runs = [(n, t0 + timedelta(seconds=draw.randrange(4 * 3600))) for n in (1, 1, 2)] + ([(None, t0)] if part == 1 else [])
        feed.put(some, PACKETS)
        spark.createDataFrame(runs, starts).coalesce(1).write.parquet(str(tmp_path / "runs" / str(part)))
        sent, begun = sent + some, begun + runs
        run()
    feed.put([(9, T0 + timedelta(days=9), 1)], PACKETS)  # moves the watermark past the rest
    spark.createDataFrame([(9, T0 + timedelta(days=9))], starts).coalesce(1).write.parquet(str(tmp_path / "runs" / "last"))
    run()
    columns = ["node", "run_id", "seg_index", "n_samples", "first_ts", "last_ts", "seg_start"]
    got = spark.read.parquet(feed.dir("cut")).select([F.col(c).cast("timestamp_ntz") if c.endswith(("ts", "start")) else F.col(c) for c in columns])
    want = segments.run_segments(spark.createDataFrame(sent, PACKETS), spark.createDataFrame(begun, starts), length).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30


def test_repeated_batch_replaces_itself(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.write_batch(rows([(1,)], "a bigint"), path, 0)
    assert sinks.read_batches(spark, path, "a bigint").count() == 1


def test_tee_partials_combine(spark, feed):
    for seed in range(3):
        feed.put(packets(seed), PACKETS)
    cut = lambda b: segments.clock_segments(b, timedelta(days=1))
    sinks.tee_sinks(feed.stream(PACKETS), {"day": (cut, feed.dir("day")), "raw": (lambda b: b, feed.dir("raw"))},
                    feed.dir("cp")).awaitTermination()
    day = sinks.read_batches(spark, feed.dir("day"), "n_samples bigint").agg(F.sum("n_samples")).first()[0]
    assert day == sinks.read_batches(spark, feed.dir("raw"), PACKETS).count() == 120


def test_no_batch_reads_as_no_rows(spark, tmp_path):
    assert sinks.read_batches(spark, str(tmp_path / "never"), "a bigint").count() == 0
