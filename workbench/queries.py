"""One check query per operator: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.functions import names as nm
from segtide.functions import routing, signal
from segtide.functions.times import slot_start, from_us, us
from segtide.operators import capture, catalog, nodes, pages, playlist, playout, resample, schedule, segments, uploads
from segtide.plans.day_playlists import day_playlists
from segtide.plans.delayed_playout import delayed_playout, listed_names
from segtide.plans.live_to_store import live_to_store
from segtide.session import configure, shared_dir
from segtide.sources import layout, objects, pcm, sinks, tree
from segtide.sources.listing import listing_extract
from segtide.streaming import frames, live, polls, queue, upload
from segtide.streaming import runs as stream_runs
from workbench import tables as tb
from workbench.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(configure(spark), sf_dir))

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def digits(samples: Column) -> Column:
    """An array as text: its values in millionths."""
    return F.array_join(F.transform(samples, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string")), ",")


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def finished(spark: SparkSession, start: Callable[[str, str], object], schema: str, label: str) -> DataFrame:
    """Run an append-sink stream over what is there now and read its output."""
    out, checkpoint = shared_dir(spark, label), shared_dir(spark, f"{label}-checkpoint")
    start(out, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(out)


# Sources and sinks

@query
def listing_extract_(t: Tables) -> DataFrame:
    return listing_extract(t.raw("pages"), tb.MARKER)


@query
def build_catalog(t: Tables) -> DataFrame:
    good, bad = catalog.build_catalog(t.names().select("url", "filepath"), tb.PREFIX, tb.POSTFIX)
    return (good.withColumn("kind", F.lit("good"))
            .unionByName(bad.withColumn("kind", F.lit("bad")), allowMissingColumns=True))


@query
def plan_listing_days(t: Tables) -> DataFrame:
    return schedule.plan_listing_days(t.requests(), "archive").select("event_id", "node", "day_path")


@query
def scan_days_pruned(t: Tables) -> DataFrame:
    path = layout.write_days(t.catalog(), shared_dir(t.spark, "days"))
    days = [(tb.NOW - tb.DELAY).strftime("%Y-%m-%d"), tb.NOW.strftime("%Y-%m-%d")]
    return layout.scan_days(t.spark, path, days,
                            "node bigint, file_time timestamp_ntz, filepath string, day string")


@query
def watch_tree_source(t: Tables) -> DataFrame:
    path = layout.write_layout(t.events().withColumn("day", F.date_format("ts", "yyyy-MM-dd")),
                               shared_dir(t.spark, "tree"), ("day",))
    stream = tree.watch_tree(t.spark, path, tb.EVENTS).drop("props")
    return finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double", "watched")


def written_objects(t: Tables) -> tuple[str, DataFrame]:
    """A tree of files made of the events, and their file events (without the contents)."""
    folder = shared_dir(t.spark, "objects")
    path = shared_dir(t.spark, "object-events")
    made = t.objects(folder)
    failed = objects.put_objects(made.withColumn("path", F.concat_ws("/", "path", "filename"))).where("error is not null").count()
    assert not failed, failed
    made.drop("content").write.parquet(path)
    return folder, t.spark.read.parquet(path)


def stored_and_left(t: Tables, store: str, tree_dir: str) -> DataFrame:
    """What is in the store and what still is in the tree, with a hash of the contents."""
    def listed(root: str, place: str) -> DataFrame:
        return objects.list_objects(t.spark, root, content=True).select(
            F.col("path").alias("object_key"), F.col("length").alias("n_bytes"), F.md5("content").alias("digest"), F.lit(place).alias("place"))

    return listed(store, "store").unionByName(listed(tree_dir, "tree"))


@query
def move_sink(t: Tables) -> DataFrame:
    folder, _ = written_objects(t)
    store, manifest = shared_dir(t.spark, "store"), shared_dir(t.spark, "manifest")
    below = F.regexp_extract("path", "(node[0-9]+)/(.*)$", 0)
    node = F.regexp_extract("path", "node([0-9]+)/hls/", 1).cast("int")
    found = tree.watch_files(t.spark, folder).select("path", below.alias("object_key"), F.lit("hls").alias("kind"), F.when(
        node % 4 == 0, "prod").when(node % 4 == 1, "custom").when(node % 4 == 2, "dev").alias("bucket_type"))
    target = F.when(~F.col("unrouted"), F.concat_ws("/", F.lit(store), "bucket", "object_key"))
    moves = routing.with_bucket(found, tb.ROUTES).select(F.col("path").alias("source"), target.alias("target"))
    objects.move_sink(moves, manifest, shared_dir(t.spark, "move-checkpoint")).awaitTermination()
    return stored_and_left(t, store, folder)


@query
def watch_tree_frames(t: Tables) -> DataFrame:
    """Sound files that appear in a tree, decoded as they come; every tenth is cut short and must reach the quarantine."""
    folder = shared_dir(t.spark, "sound")
    broken = F.when(F.col("path").cast("bigint") % 10 == 0, F.expr("substring(content, 1, length(content) - 1)"))
    made = pcm.pcm_write(t.frames(), "seg_id", "samples", 48000).withColumn("content", F.coalesce(broken, "content"))
    named = made.withColumn("path", F.concat(F.lit(folder), F.lit("/"), (F.col("path").cast("bigint") % 7).cast("string"), F.lit("/"), "path", F.lit(".wav")))
    failed = objects.put_objects(named).where("error is not null").count()
    assert not failed, failed
    good, bad = (shared_dir(t.spark, n) for n in ("frames", "broken"))
    frames.stream_frames(tree.watch_files(t.spark, folder, "*.wav"), good, bad, shared_dir(t.spark, "frames-checkpoint")).awaitTermination()
    name = F.regexp_extract("path", "([^/]*)[.]wav$", 1).alias("path")
    return (sinks.read_batches(t.spark, good, pcm.FRAMES_SCHEMA).select(name, "rate", "channels", digits(F.col("samples")).alias("samples"), F.lit(None).cast("string").alias("error"))
            .unionByName(sinks.read_batches(t.spark, bad, "path string, error string").select(name, "error"), allowMissingColumns=True))


@query
def tee_sinks(t: Tables) -> DataFrame:
    def cut(length: timedelta):
        def partial(batch: DataFrame) -> DataFrame:
            return segments.clock_segments(batch, length)
        return partial

    paths = {k: shared_dir(t.spark, f"tee-{k}") for k in ("live", "archive")}
    lengths = {"live": tb.LENGTH, "archive": tb.ARCHIVE_LENGTH}
    sinks.tee_sinks(t.samples(t.event_stream()), {k: (cut(lengths[k]), p) for k, p in paths.items()},
                    shared_dir(t.spark, "tee-checkpoint")).awaitTermination()
    schema = "node bigint, seg_start timestamp_ntz, n_samples bigint, last_ts timestamp_ntz"
    both = None
    for kind, path in paths.items():
        part = (sinks.read_batches(t.spark, path, schema).groupBy("node", "seg_start")
                .agg(F.sum("n_samples").alias("n_samples"), F.max("last_ts").alias("last_ts"))
                .withColumn("kind", F.lit(kind)))
        both = part if both is None else both.unionByName(part)
    return both


@query
def partition_layout(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "hls").otherwise("flac")
    laid = t.samples().withColumn("kind", kind).withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    path = layout.write_layout(laid, shared_dir(t.spark, "layout"))
    back = layout.read_layout(t.spark, path,
                              "ts timestamp_ntz, event_id bigint, value double, node bigint, kind string, run_id string")
    return back.groupBy("node", "kind", "run_id").agg(
        F.count("*").alias("n_samples"), F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"))


@query
def pcm_write_job(t: Tables) -> DataFrame:
    return pcm.pcm_write(t.frames(), "seg_id", "samples", 48000).select(
        F.col("path").alias("seg_id"), F.length("content").cast("bigint").alias("n_bytes"),
        F.lower(F.hex("content")).alias("payload"))


@query
def pcm_read_job(t: Tables) -> DataFrame:
    payloads = pcm.pcm_write(t.frames(), "seg_id", "samples", 48000)
    path = shared_dir(t.spark, "payloads")
    # every tenth payload is cut short: those must reach the quarantine
    broken = F.when(F.col("path").cast("bigint") % 10 == 0, F.expr("substring(content, 1, length(content) - 1)"))
    payloads.withColumn("content", F.coalesce(broken, "content")).write.parquet(path)
    good, bad = pcm.pcm_read(t.spark.read.parquet(path))
    return (good.select("path", "rate", "channels", digits(F.col("samples")).alias("samples"))
            .unionByName(bad, allowMissingColumns=True))


# Projections and scalar functions

@query
def parse_file_time(t: Tables) -> DataFrame:
    parsed = nm.parse_file_time(F.col("filepath"), tb.PREFIX, tb.POSTFIX)
    return t.catalog().select("event_id", "filepath", parsed.alias("parsed"))


@query
def full_url(t: Tables) -> DataFrame:
    return t.catalog().select("event_id", nm.full_url(F.col("url"), F.col("filepath")).alias("full_url"))


@query
def derive_names(t: Tables) -> DataFrame:
    return nm.derive_names(t.catalog()).select("event_id", "wav_name", "ts_name", "name_collision")


@query
def segment_names(t: Tables) -> DataFrame:
    return nm.segment_names(schedule.segment_schedule(t.ranges(), timedelta(minutes=15)), tb.PREFIX).select(
        "event_id", "seg_start", "subdir", "wav_name", "ts_name")


@query
def archive_name(t: Tables) -> DataFrame:
    cuts = segments.clock_segments(t.device_samples(), tb.ARCHIVE_LENGTH)
    named = nm.archive_name(F.col("seg_start"), F.col("node_name"), F.col("sample_rate"), F.col("channels"))
    return cuts.join(t.node_config(), "node").select("node_name", "seg_start", named.alias("archive_name"))


@query
def live_name(t: Tables) -> DataFrame:
    # one-second cuts: the index passes 999
    cut = segments.run_segments(t.samples(), t.runs(), timedelta(seconds=1))
    return cut.select("node", "run_id", "seg_index", nm.live_name(F.col("seg_index")).alias("live_name"))


@query
def object_key(t: Tables) -> DataFrame:
    return t.file_events().select("event_id", nm.object_key(F.col("path"), F.col("filename")).alias("object_key"))


@query
def bucket_route(t: Tables) -> DataFrame:
    kinds = F.explode(F.array(F.lit("hls"), F.lit("flac"))).alias("kind")
    return routing.with_bucket(t.node_config().select("node_name", "bucket_type", kinds), tb.ROUTES)


@query
def gain(t: Tables) -> DataFrame:
    return t.frames().select("seg_id", digits(signal.gain(F.col("samples"))).alias("samples"))


@query
def interleave(t: Tables) -> DataFrame:
    return t.frames().select("seg_id", digits(signal.interleave(F.col("ch1"), F.col("ch2"))).alias("samples"))


@query
def packet_pts(t: Tables) -> DataFrame:
    pts = signal.packet_pts(*[F.col(c) for c in ("now_s", "cycle_delay", "rate", "latencies")])
    return t.packets().select("event_id", pts.alias("pts"))


@query
def apply_type_overrides(t: Tables) -> DataFrame:
    return routing.apply_type_overrides(t.node_config()).select(
        "node_name", "node_type", "sample_rate", "stream_rate", "live_channels")


# Filters

@query
def eligible_files(t: Tables) -> DataFrame:
    return catalog.eligible_files(t.catalog(), tb.NOW, tb.DELAY, tb.SEGMENT)


@query
def file_event_filter(t: Tables) -> DataFrame:
    return uploads.file_event_filter(t.file_events()).select("event_id", "path", "filename")


@query
def config_check(t: Tables) -> DataFrame:
    return routing.config_check(t.node_config()).select(
        "node_name", F.array_join("missing", ",").alias("missing"),
        F.array_join("warnings", ",").alias("warnings"), "passes")


@query
def queue_state(t: Tables) -> DataFrame:
    return catalog.queue_state(t.catalog(), tb.NOW, tb.DELAY).select("event_id", "filepath", "state")


# Joins

@query
def anti_done(t: Tables) -> DataFrame:
    return catalog.anti_done(t.catalog(), t.done(), catalog.ledger_filter(t.done()))


@query
def skip_existing(t: Tables) -> DataFrame:
    return schedule.skip_existing(t.segments(), t.present()).select("node", "seg_start", "ts_name")


@query
def missing_segments(t: Tables) -> DataFrame:
    return schedule.missing_segments(t.odd_segments(), t.samples()).select("node", "seg_start", "seg_end")


@query
def asof_run(t: Tables) -> DataFrame:
    return segments.asof_run(t.samples(), t.runs()).select("event_id", "node", "run_id")


@query
def playing_at(t: Tables) -> DataFrame:
    return playout.playing_at(t.catalog(), t.ticks(), tb.DELAY).select("tick", "node", "filepath")


@query
def next_available(t: Tables) -> DataFrame:
    found = catalog.next_available(t.catalog(), t.node_ticks(), t.done(), tb.DELAY, tb.SEGMENT, by=["node"])
    return found.select("node", "tick", from_us("next_us").alias("next_time"), "wait_us")


@query
def node_outputs(t: Tables) -> DataFrame:
    return nodes.node_outputs(t.node_config(), nodes.output_kinds(t.spark)).select("node_name", "node_type", "kind")


@query
def support_check(t: Tables) -> DataFrame:
    yes, no = nodes.support_check(t.node_config(), nodes.support_matrix(t.spark))
    return (yes.withColumn("supported", F.lit(True)).unionByName(no.withColumn("supported", F.lit(False)))
            .select("node_name", "node_arch", "node_type", "supported"))


# Aggregations

@query
def run_counters(t: Tables) -> DataFrame:
    return catalog.run_counters(t.catalog(), tb.NOW, tb.DELAY, tb.SEGMENT, by=["node"])


@query
def segment_duration(t: Tables) -> DataFrame:
    cut = t.samples().withColumn("seg_start", from_us(slot_start(us("ts"), tb.LENGTH)))
    return segments.segment_duration(cut, ["node", "seg_start"]).select(
        "node", "seg_start", "n_samples", r6("duration_s"), r6("sample_rate"))


@query
def latest_pointer(t: Tables) -> DataFrame:
    return playlist.latest_pointer(t.runs())


@query
def build_playlist(t: Tables) -> DataFrame:
    return playlist.build_playlist(t.segments(), ["node", "subdir"])


@query
def append_playlist(t: Tables) -> DataFrame:
    old = t.segments().where(F.hour("seg_start") < 12)
    new = t.segments().where(F.hour("seg_start") >= 12)
    return playlist.append_playlist(playlist.build_playlist(old, ["node", "subdir"]), new, ["node", "subdir"])


@query
def paged_playlist(t: Tables) -> DataFrame:
    """One long list per node: pages of the mornings, stored; the afternoons appended; the texts of all."""
    path = shared_dir(t.spark, "pages")
    pages.store_pages(pages.build_pages(t.segments().where(F.hour("seg_start") < 12), ["node"], page_rows=100), path, ["node"])
    stored = pages.read_pages(t.spark, path, "node bigint")
    pages.store_pages(pages.append_pages(stored, t.segments(), ["node"], page_rows=100), path, ["node"])
    return pages.page_texts(pages.read_pages(t.spark, path, "node bigint"), ["node"])


@query
def downmix(t: Tables) -> DataFrame:
    return t.frames().select("seg_id", digits(signal.downmix(F.col("ch1"), F.col("ch2"))).alias("samples"))


@query
def resample_down(t: Tables) -> DataFrame:
    return resample.resample_down(t.samples(), tb.LENGTH).select("node", "slot", r6("value"), "n_samples")


@query
def resample_up(t: Tables) -> DataFrame:
    return resample.resample_up(t.samples(), tb.STEP_UP).select("node", "slot", r6("value"))


@query
def gap_fill(t: Tables) -> DataFrame:
    return resample.gap_fill(t.samples(), t.odd_segments(), tb.STEP_UP).select(
        "node", "segment", "slot", F.round("value", 9).alias("value"))


# Windows

@query
def run_segments(t: Tables) -> DataFrame:
    return segments.run_segments(t.samples(), t.runs(), timedelta(minutes=10)).drop("run_start_us")


@query
def clock_segments(t: Tables) -> DataFrame:
    return segments.clock_segments(t.samples(), tb.LENGTH, origin=timedelta(minutes=7))


@query
def xrun_flags(t: Tables) -> DataFrame:
    return capture.xrun_flags(t.samples(), tb.GAP).select("event_id", "node", "gap_us", "xrun")


@query
def reset_islands(t: Tables) -> DataFrame:
    return capture.reset_islands(t.samples(), tb.GAP)


@query
def clock_fit(t: Tables) -> DataFrame:
    # cut at the eighth place, between values that microseconds divided by few packets never take
    return capture.clock_fit(t.samples(), tb.GAP).select(
        "node", "first_ts", "n_packets", *[(F.floor(F.col(c) * 1e8 + 0.381966) / 1e8).alias(c) for c in ("slope", "intercept", "r2")])


@query
def stall_report(t: Tables) -> DataFrame:
    return capture.stall_report(t.samples(), tb.TIMEOUT, F.expr("timestamp_ntz'2024-01-31 00:00:00'")).select(
        "event_id", "node", "silent_us", "open")


@query
def on_air_top1(t: Tables) -> DataFrame:
    return playout.on_air_top1(playout.playing_at(t.catalog(), t.ticks(), tb.DELAY))


@query
def concat_timeline(t: Tables) -> DataFrame:
    return playout.concat_timeline(t.items()).select("list_id", "pos", "file", "offset_s")


# Generators, sorts, set operations

@query
def segment_schedule(t: Tables) -> DataFrame:
    return schedule.segment_schedule(t.ranges(), timedelta(minutes=15)).select(
        "event_id", "node", "seg_start", "seg_end")


@query
def loop_expand(t: Tables) -> DataFrame:
    return playout.loop_expand(t.items(), 3).select("list_id", "pos", "file")


@query
def conversion_order(t: Tables) -> DataFrame:
    return catalog.conversion_order(t.catalog(), 50).select("node", "rank", "filepath")


@query
def near_and_backfill(t: Tables) -> DataFrame:
    return schedule.near_and_backfill(t.requests(), tb.LENGTH)


@query
def accumulate_converted(t: Tables) -> DataFrame:
    files = t.catalog()
    batches = [files.where(F.col("event_id") % 3 != i) for i in range(3)]
    return playout.accumulate_converted(batches).select("filepath", "event_id", "attempt")


# Streaming

@query
def stream_poll_catalog(t: Tables) -> DataFrame:
    listing = t.catalog(t.event_stream()).drop("file_time")
    stream = polls.stream_poll_catalog(listing, tb.NOW, tb.DELAY, tb.SEGMENT, tb.PREFIX, tb.POSTFIX)
    return finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                    "node bigint, file_time timestamp_ntz, filepath string", "polled")


@query
def stream_polls(t: Tables) -> DataFrame:
    """The poll with both of its outputs: eligible files, and names of the listing that can't be read."""
    feed = shared_dir(t.spark, "listing")
    t.names().select("node", "url", "filepath").write.parquet(feed)
    listing = t.spark.readStream.schema("node bigint, url string, filepath string").parquet(feed)
    files, bad = shared_dir(t.spark, "polled"), shared_dir(t.spark, "bad-names")
    polls.poll_sinks(listing, tb.NOW, tb.DELAY, tb.SEGMENT, tb.PREFIX, tb.POSTFIX, files, bad, shared_dir(t.spark, "poll-checkpoint"), every=None).awaitTermination()
    pick = ["node", "url", "filepath"]
    return (sinks.read_batches(t.spark, files, "node bigint, url string, filepath string").select(*pick, F.lit("eligible").alias("kind"))
            .unionByName(sinks.read_batches(t.spark, bad, "node bigint, url string, filepath string").select(*pick, F.lit("bad").alias("kind"))))


@query
def stream_dedup_done(t: Tables) -> DataFrame:
    twice = t.catalog(t.event_stream()).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    stream = polls.stream_dedup_done(twice, tb.DELAY)
    return ntz(finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                        "node bigint, file_time timestamp, filepath string", "deduped"), "file_time")


@query
def stream_segments(t: Tables) -> DataFrame:
    stream = live.stream_segments(t.samples(t.event_stream()), tb.LENGTH, tb.LATENESS)
    out = finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                   "node bigint, seg_start timestamp, n_samples bigint, last_ts timestamp", "segments")
    return ntz(out, "seg_start", "last_ts")


@query
def stream_run_segments(t: Tables) -> DataFrame:
    cut = stream_runs.stream_run_segments(t.samples(t.event_stream()), t.runs(t.event_stream()), timedelta(minutes=10), tb.LATENESS)
    schema = "node bigint, run_id bigint, seg_index bigint, n_samples bigint, first_ts timestamp, last_ts timestamp, seg_start timestamp"
    return ntz(finished(t.spark, lambda out, cp: sinks.append_sink(cut, out, cp), schema, "run-segments"), "first_ts", "last_ts", "seg_start")


@query
def stream_late_drop(t: Tables) -> DataFrame:
    paths = [shared_dir(t.spark, n) for n in ("kept", "late", "high", "late-checkpoint")]
    polls.stream_late_drop(t.catalog(t.event_stream()), timedelta(days=10), *paths).awaitTermination()
    kept, late = [sinks.read_batches(t.spark, p, "filepath string, event_id bigint") for p in paths[:2]]
    return (kept.withColumn("outcome", F.lit("kept")).unionByName(late.withColumn("outcome", F.lit("late")))
            .drop("batch_id"))


@query
def stream_islands(t: Tables) -> DataFrame:
    stream = live.stream_islands(t.samples(t.event_stream()), tb.GAP, tb.LATENESS)
    out = finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                   "node bigint, first_ts timestamp, last_ts timestamp, n_packets bigint", "islands")
    return ntz(out, "first_ts", "last_ts")


@query
def stream_playout_queue(t: Tables) -> DataFrame:
    stream = queue.stream_playout_queue(t.catalog(t.event_stream()), tb.DELAY, tb.LATENESS)
    return ntz(finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp), queue.OUTPUT, "queue"), "at")


@query
def stream_stall_alert(t: Tables) -> DataFrame:
    stream = live.stream_stall_alert(t.samples(t.event_stream()), timedelta(hours=1), tb.LATENESS)
    out = finished(t.spark, lambda out, cp: sinks.append_sink(stream, out, cp),
                   "node bigint, silent_since timestamp, alert_at timestamp", "alerts")
    return ntz(out, "silent_since", "alert_at")


@query
def stream_latest_pointer(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "latest")
    live.stream_latest_pointer(t.runs(t.event_stream()), path, shared_dir(t.spark, "latest-checkpoint")).awaitTermination()
    return live.latest_pointers(t.spark, path).read()


@query
def stream_upload(t: Tables) -> DataFrame:
    folder, events = written_objects(t)
    store, manifest, feed = (shared_dir(t.spark, n) for n in ("store", "manifest", "file-events"))
    events.write.parquet(feed)
    stream = t.spark.readStream.schema(events.schema).parquet(feed)
    upload.stream_upload(stream, tb.ROUTES, store, manifest, shared_dir(t.spark, "upload-checkpoint"), root=folder).awaitTermination()
    return stored_and_left(t, store, folder)


@query
def stream_counters(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "counters")
    polls.stream_counters(t.catalog(t.event_stream()), tb.NOW, tb.DELAY, tb.SEGMENT, path,
                          shared_dir(t.spark, "counters-checkpoint")).awaitTermination()
    counts = ("listed", "to_convert", "played", "deleted")
    rows = sinks.read_batches(t.spark, path, ", ".join(f"{c} bigint" for c in counts))
    return rows.agg(*[F.sum(c).alias(c) for c in counts])


# End to end

@query
def delayed_playout_(t: Tables) -> DataFrame:
    # the listing as a store keeps it: a folder for each day's pages
    day = F.concat_ws("-", *[F.regexp_extract("url", "^archive/([0-9]+)/([0-9]+)/([0-9]+)$", i) for i in (1, 2, 3)])
    path = layout.write_layout(t.names().withColumn("day", day), shared_dir(t.spark, "listing"), ("day",))
    names = listed_names(t.spark, path, tb.NOW, tb.DELAY, "node bigint, url string, filepath string, duration_s double, day string")
    return delayed_playout(names, t.done(), tb.NOW, tb.DELAY, tb.SEGMENT, tb.PREFIX, tb.POSTFIX, tb.LATER)


@query
def day_playlists_(t: Tables) -> DataFrame:
    return day_playlists(t.requests(), t.present(), t.samples(), tb.LENGTH, tb.PREFIX)


@query
def live_to_store_(t: Tables) -> DataFrame:
    return live_to_store(t.node_config(), t.device_samples(), t.runs(key="user_id"),
                         nodes.output_kinds(t.spark), nodes.support_matrix(t.spark), tb.ROUTES)
