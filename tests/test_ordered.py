"""Chunked ordering against plain windows, with hot, sparse, tied and keyless rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.functions.times import us
from segtide.operators import capture, ordered, segments

SCHEMA = "node bigint, ts timestamp_ntz, event_id bigint, value double"


def make(seed: int, n: int = 600):
    rnd = random.Random(seed)
    start, out = datetime(2024, 1, 1), []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.4:      # one node, one minute: a hot bucket
            node, t = 1, start + timedelta(microseconds=rnd.randrange(60_000_000))
        elif kind < 0.6:    # ties
            node, t = rnd.choice([1, 2]), start + timedelta(seconds=rnd.randrange(5))
        elif kind < 0.65:   # one instant
            node, t = 1, start + timedelta(seconds=30)
        elif kind < 0.7:    # no node
            node, t = None, start + timedelta(minutes=rnd.randrange(600))
        else:               # sparse, also before the epoch of the others
            node, t = rnd.choice([0, 2, 3]), start + timedelta(minutes=rnd.randrange(-5000, 50_000))
        out.append((node, t, i, float(rnd.randrange(100))))
    return out


@pytest.fixture(params=[1, 2])
def packets(rows, request):
    return rows(make(request.param), SCHEMA)


def same(a, b):
    key = lambda r: tuple((v is None, v) for v in r)
    left, right = [sorted((tuple(r) for r in d.collect()), key=key) for d in (a, b.select(*a.columns))]
    assert left == right


@pytest.mark.parametrize("max_rows", [7, 50, 1_000_000])
def test_neighbours_and_ranks(packets, max_rows):
    timed = packets.withColumn("_us", us("ts"))
    w = W.partitionBy("node").orderBy("_us", "event_id")
    kw = dict(keys=["node"], time_us="_us", order=["_us", "event_id"], tie="event_id", max_rows=max_rows)
    pick = ["node", "event_id"]
    same(ordered.with_previous_time(timed, **kw).select(*pick, "prev_us"),
         timed.select(*pick, F.lag("_us").over(w).alias("prev_us")))
    same(ordered.with_next_time(timed, **kw).select(*pick, "next_us"),
         timed.select(*pick, F.lead("_us").over(w).alias("next_us")))
    same(ordered.with_rank(timed, **kw).select(*pick, "rank"),
         timed.select(*pick, F.row_number().over(w).cast("bigint").alias("rank")))
    whole = F.col("value").cast("bigint")
    same(ordered.with_running_sum(timed, value=whole, out="sum", **kw).select(*pick, "sum"),
         timed.select(*pick, F.coalesce(F.sum(whole).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("sum")))
    with pytest.raises(TypeError):
        ordered.with_running_sum(timed, value=F.col("value"), out="sum", **kw)


def test_hot_bucket_is_cut(packets):
    timed = packets.withColumn("_us", us("ts"))
    parts = (ordered.scanned(timed, ["node"], "_us", {}, tie="event_id", max_rows=10)
             .groupBy(*ordered.chunk_columns(["node"])).count())
    assert parts.where("_part > 0 and _key_node = 1").count() > 10
    # a part ends with the slot (of time, or of ties) in which it became full
    assert parts.agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("max_rows", [7, 1_000_000])
def test_islands(packets, max_rows):
    gap = timedelta(minutes=5)
    w = W.partitionBy("node").orderBy("ts", "event_id")
    flagged = packets.withColumn("_new", F.coalesce(us("ts") - us(F.lag("ts").over(w)) > 300_000_000, F.lit(True)))
    numbered = flagged.withColumn("_i", F.sum(F.col("_new").cast("int")).over(w))
    plain = numbered.groupBy("node", "_i").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                               F.count("*").alias("n_packets"))
    same(capture.reset_islands(packets, gap, max_rows=max_rows), plain)
    numbers = capture.with_island(packets, gap, max_rows=max_rows).select("event_id", "packet_no")
    inside = W.partitionBy("node", "_i").orderBy("ts", "event_id")
    same(numbers, numbered.select("event_id", (F.row_number().over(inside) - 1).cast("bigint").alias("packet_no")))


@pytest.mark.parametrize("max_rows", [7, 1_000_000])
def test_asof_run(packets, max_rows):
    runs = packets.where("event_id % 5 = 0").select("node", F.col("ts").alias("started_at"))
    found = segments.asof_run(packets, runs, max_rows=max_rows).select("event_id", "run_start_us")
    plain = (packets.alias("s").join(runs.alias("r"), F.expr("s.node <=> r.node and r.started_at <= s.ts"), "left")
             .groupBy("event_id").agg(F.max(us("started_at")).alias("run_start_us")))
    same(found, plain)


def test_zoned_times_and_other_key_types(rows):
    df = rows([("a", datetime(2024, 1, 1), 0), ("a", datetime(2024, 1, 3), 1), (None, datetime(2024, 1, 2), 2)],
              "node string, ts timestamp, event_id bigint")
    got = capture.reset_islands(df, timedelta(hours=1))
    assert dict(got.dtypes)["first_ts"] == "timestamp" and got.count() == 3
    by_day = df.withColumn("day", F.to_date("ts")).withColumn("_us", us("ts"))
    ranked = ordered.with_rank(by_day, ["node", "day"], "_us", ["_us"])
    assert [r["rank"] for r in ranked.collect()] == [1, 1, 1]
