"""A key with a third of all rows is split by adaptive execution, not left to one task."""

import pytest
from pyspark.sql import functions as F

from segtide.functions import names
from segtide.operators import catalog, playout, schedule
from segtide.operators.intervals import stab_join

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "16",
}
N = 30_000


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split(df) -> bool:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def files(small):
    """A third of the rows have one path, one node and one list."""
    hot = F.col("id") % 3 == 0
    path = F.when(hot, "hot-2024-01-01T00:00:00.000000.mseed").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"),
                                                                                F.lit("-2024-01-01T00:00:00.000000.mseed")))
    return small.range(0, N, 1, 8).select(
        path.alias("filepath"), F.when(hot, 1).otherwise(F.col("id") % 50 + 2).alias("list_id"), F.col("id").alias("pos"),
        F.lit("x").alias("file"), F.lit(1.0).alias("duration_s"))


def test_colliding_names(files):
    named = names.derive_names(files)
    assert split(named) and named.where("name_collision").count() == N // 3


def test_ledger(files):
    done = files.where("pos % 7 = 0").select("filepath")
    left = catalog.anti_done(files, done)
    assert split(left)
    assert left.count() == sum(1 for i in range(N) if i % 3 and i % 7)


def test_loops(files):
    looped = playout.loop_expand(files, 2)
    assert split(looped) and looped.count() == 2 * N


def test_sample_counts(small, rows):
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hour = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700)
    start = t0 + F.make_dt_interval(hours=hour.cast("int"))
    segments = small.range(0, N, 1, 8).select(F.lit(1).alias("node"), start.alias("seg_start"),
                                                (start + F.expr("interval 1 hour")).alias("seg_end"), "id")
    samples = segments.where("id < 50").select("node", F.col("seg_start").alias("ts"))
    counted = schedule.with_sample_counts(segments, samples)
    assert split(counted) and counted.count() == N


def test_range_join(small):
    start = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 10_000_000)
    spans = small.range(0, N, 1, 8).select("id", start.alias("a"), (start + 30_000_000).alias("b"))
    points = small.range(0, N, 1, 8).select((F.col("id") * 10_000_000 + 5).alias("p")).where("p > 20000000")
    joined = stab_join(spans, points, "a", "b", "p")
    assert split(joined)
    ids = [i for i in range(N)]
    want = sum(sum(1 for k in range(4) if s < (p := (s // 10_000_000 + k) * 10_000_000 + 5) <= s + 30_000_000
                   and 20_000_000 < p < N * 10_000_000) for s in (0 if i % 3 == 0 else i * 10_000_000 for i in ids))
    assert joined.count() == want


@pytest.mark.parametrize("size", [64, 1 << 12, 1 << 20])
def test_ledger_filter_passes_new_files_by(files, size):
    """Exact with any filter, also one that is full; a new path with a third of all rows is not shuffled."""
    done = files.where("pos % 7 = 0 and pos % 3 <> 0").select("filepath")
    null = files.limit(1).withColumn("filepath", F.lit(None).cast("string"))
    left = catalog.anti_done(files.unionByName(null), done, catalog.ledger_filter(done, size), size)
    assert left.count() == 1 + sum(1 for i in range(N) if i % 3 == 0 or i % 7)
    if size == 1 << 20:
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Union") >= 1
        old = catalog.anti_done(files, done, catalog.ledger_filter(done, size), size)
        old.write.format("noop").mode("overwrite").save()
        hot = files.where("filepath like 'hot%'")
        assert catalog.anti_done(hot, done, catalog.ledger_filter(done, size), size).count() == N // 3
