"""The inputs of the operators, made from the given tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.functions.routing import Buckets
from segtide.functions.names import segment_names
from segtide.functions.times import from_us, us
from segtide.operators.ordered import with_rank
from segtide.operators.schedule import segment_schedule
from segtide.operators.steps import explode_steps
from segtide.session import shared_dir
from segtide.sources.listing import listing_extract

NOW = datetime(2024, 1, 16)
DELAY = timedelta(hours=24)
SEGMENT = timedelta(hours=6)
LATER = timedelta(hours=3)
PREFIX, POSTFIX = "OO-HYVM2--YDH-", ".mseed"
MARKER = "tion"
GAP = timedelta(minutes=30)
TIMEOUT = timedelta(hours=3)
LENGTH = timedelta(hours=1)
ARCHIVE_LENGTH = timedelta(hours=6)
STEP_UP = timedelta(minutes=10)
LATENESS = timedelta(hours=1)
ROUTES = {"hls": Buckets("prod-live", "dev-live", "own-live"),
          "flac": Buckets("prod-archive", "dev-archive", "own-archive")}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
TYPES = ("research", "hls-only", "dev-virt-s3", "debug", "other")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:  # the footer is read once
            self._read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._read[name]

    def events(self) -> DataFrame:
        return self.raw("events")

    def event_stream(self) -> DataFrame:
        # a pattern serves a single file and a folder of files alike
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.dir}/events.parque[t]")

    def samples(self, events: DataFrame | None = None) -> DataFrame:
        events = self.events() if events is None else events
        return events.select((F.col("user_id") % 8).alias("node"), "ts", "event_id", "value")

    def device_samples(self) -> DataFrame:
        """Samples by device; devices are the suppliers with that key."""
        return self.events().select(F.col("user_id").alias("node"), "ts", "event_id", "value")

    def catalog(self, events: DataFrame | None = None) -> DataFrame:
        events = self.events() if events is None else events
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return events.select(
            (F.col("user_id") % 8).alias("node"), F.col("ts").alias("file_time"),
            F.concat(F.lit("archive/"), F.date_format("ts", "yyyy/MM/dd")).alias("url"),
            F.concat(F.lit(PREFIX), stamp, F.lit(POSTFIX)).alias("filepath"),
            (F.lit(600) * (F.col("event_id") % 5 + 1)).cast("double").alias("duration_s"), "event_id")

    def names(self, events: DataFrame | None = None) -> DataFrame:
        """File names as listed: those of the catalogue and text nodes that are no file names."""
        listed = self.catalog(events).select("node", "url", "filepath", "duration_s")
        other = listing_extract(self.raw("pages"), MARKER).select("url", F.col("node_text").alias("filepath"))
        return listed.unionByName(other, allowMissingColumns=True)

    def done(self) -> DataFrame:
        return self.catalog().where("event_id % 3 = 0").select("filepath")

    def runs(self, events: DataFrame | None = None, key: str = "user_id % 8") -> DataFrame:
        events = self.events() if events is None else events
        return events.where("event_type = 'signup'").select(
            F.expr(key).alias("node"), F.col("ts").alias("started_at"),
            F.call_function("div", us("ts"), F.lit(1_000_000)).alias("run_id"), F.col("ts").alias("written_at"))

    def requests(self) -> DataFrame:
        return self.events().where("event_type = 'signup'").select(
            "event_id", (F.col("user_id") % 8).alias("node"), F.col("ts").alias("now"),
            F.expr("make_dt_interval(0, cast(24 * (1 + event_id % 3) as int), 0, 0)").alias("delay"))

    def ranges(self) -> DataFrame:
        length = F.expr("make_dt_interval(0, cast(1 + event_id % 8 as int), 7, 0)")
        return self.events().where("event_type = 'signup'").select(
            "event_id", (F.col("user_id") % 8).alias("node"), F.col("ts").alias("start"),
            (F.col("ts") + length).alias("end"))

    def _with_ticks(self, rows: DataFrame) -> DataFrame:
        """Every 150 s from 2024-01-01 up to 2024-01-30, for each row."""
        first, last = 1_704_067_200_000_000, 1_706_572_800_000_000
        return explode_steps(rows, F.lit(first), F.lit(last), 150_000_000, "_at").withColumn("tick", from_us("_at")).drop("_at")

    def ticks(self) -> DataFrame:
        return self._with_ticks(self.spark.range(1)).drop("id")

    def node_ticks(self) -> DataFrame:
        """Every tick for every node of the catalogue."""
        return self._with_ticks(self.catalog().select("node").where("node is not null").distinct())

    def segments(self) -> DataFrame:
        """One-hour schedule of January 2024 for every node in the events, with names."""
        nodes = self.samples().select("node").distinct()
        ranges = nodes.select("node", F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("start"),
                              F.expr("timestamp_ntz'2024-02-01 00:00:00'").alias("end"))
        return segment_names(segment_schedule(ranges, LENGTH), PREFIX)

    def odd_segments(self) -> DataFrame:
        """Segments off every grid, of 42 minutes: from 7 past the hour to 11 before the next."""
        return self.segments().withColumn("seg_start", F.col("seg_start") + F.expr("interval 7 minutes")).withColumn(
            "seg_end", F.col("seg_end") - F.expr("interval 11 minutes"))

    def present(self) -> DataFrame:
        return self.segments().where(F.hour("seg_start") % 4 == 0)

    def file_events(self, events: DataFrame | None = None) -> DataFrame:
        events = self.events() if events is None else events
        kind = (F.when(F.col("event_type") == "click", "IN_CLOSE_WRITE")
                .when(F.col("event_type") == "signup", "IN_MOVED_TO").otherwise("IN_CREATE"))
        node = F.col("user_id") % 8
        day = F.call_function("div", us("ts"), F.lit(86_400_000_000))
        return events.select(
            "event_id", node.alias("node"), F.array(kind, F.lit("X")).alias("types"),
            F.concat(F.lit("/tmp/node"), node.cast("string"), F.lit("/hls/"), day.cast("string")).alias("path"),
            F.concat(F.lit("live"), F.col("event_id").cast("string"),
                     F.when(F.col("event_id") % 10 == 0, ".m3u8.tmp").otherwise(".ts")).alias("filename"),
            F.lit("hls").alias("kind"),
            F.when(node % 4 == 0, "prod").when(node % 4 == 1, "custom").when(node % 4 == 2, "dev").alias("bucket_type"))

    def objects(self, tree: str) -> DataFrame:
        """One file per node, day and kind of event below a tree, with the events as its lines; its id is that of its first event."""
        line = F.concat_ws(",", F.col("event_id").cast("string"), us("ts").cast("string"))
        day = F.call_function("div", us("ts"), F.lit(86_400_000_000))
        files = self.events().groupBy((F.col("user_id") % 8).alias("node"), day.alias("day"), "event_type").agg(
            F.min("event_id").alias("event_id"), F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
        kind = (F.when(F.col("event_type") == "click", "IN_CLOSE_WRITE")
                .when(F.col("event_type") == "signup", "IN_MOVED_TO").otherwise("IN_CREATE"))
        node = F.col("node")
        return files.select(
            "event_id", "node", F.array(kind, F.lit("X")).alias("types"),
            F.concat(F.lit(tree + "/node"), node.cast("string"), F.lit("/hls/"), F.col("day").cast("string")).alias("path"),
            F.concat(F.lit("live"), F.col("event_id").cast("string"),
                     F.when(F.col("event_id") % 10 == 0, ".m3u8.tmp").otherwise(".ts")).alias("filename"),
            F.lit("hls").alias("kind"),
            F.when(node % 4 == 0, "prod").when(node % 4 == 1, "custom").when(node % 4 == 2, "dev").alias("bucket_type"),
            F.array_join(F.col("lines.line"), "\n").cast("binary").alias("content"))

    def node_config(self) -> DataFrame:
        key = F.col("s_suppkey")
        node_type = F.get(F.array(*[F.lit(t) for t in TYPES]), (key % 5).cast("int"))
        return self.raw("supplier").select(
            key.alias("node"), F.col("s_name").alias("node_name"), node_type.alias("node_type"),
            F.when(key % 2 == 0, "arm32v7").otherwise("amd64").alias("node_arch"),
            F.when(F.col("s_nationkey") % 7 != 0, 48000 + 48000 * (key % 4)).alias("sample_rate"),
            F.when(F.col("s_nationkey") % 11 != 0, 1 + key % 2).alias("channels"),
            F.when(key % 4 == 0, "prod").when(key % 4 == 1, "custom").when(key % 4 == 2, "dev").alias("bucket_type"),
            F.lit("card0").alias("audio_hw_id"), F.lit(48000).cast("bigint").alias("stream_rate"),
            (1800 + 1800 * (key % 3)).cast("int").alias("segment_duration"),
            F.when(key % 3 != 0, 10800 * (1 + key % 2)).cast("int").alias("flac_duration"))

    def frames(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("seg_id"), F.col("embedding").alias("samples"),
            F.slice("embedding", 1, 32).alias("ch1"), F.slice("embedding", 33, 32).alias("ch2"))

    def packets(self) -> DataFrame:
        return self.events().select(
            "event_id", (us("ts") / F.lit(1_000_000)).alias("now_s"), (F.col("event_id") % 1024).alias("cycle_delay"),
            F.lit(48000).alias("rate"), F.array(F.col("event_id") % 64, F.col("event_id") % 32).alias("latencies"))

    def items(self) -> DataFrame:
        """The files of each node as a play list in time order: a table of its own."""
        timed = self.catalog().withColumn("_us", us("file_time"))
        ranked = with_rank(timed, ["node"], "_us", ["_us", "event_id"], tie="event_id")
        path = shared_dir(self.spark, "items")
        ranked.select(F.col("node").alias("list_id"), F.col("rank").alias("pos"),
                      F.col("filepath").alias("file"), "duration_s").write.parquet(path)
        return self.spark.read.parquet(path)
