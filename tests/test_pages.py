"""Paged playlists: the texts of whole ones, and what an append touches."""

import os
from datetime import timedelta

from pyspark.sql import functions as F

from segtide.operators import pages, playlist
from tests.conftest import at

SCHEMA = "node bigint, seg_start timestamp_ntz, seg_end timestamp_ntz, ts_name string"
KEY = "node bigint"
T0 = at("2024-01-01T00:00:00")


def listed(rows, first, last, node=1, seconds=10):
    return rows([(node, T0 + timedelta(seconds=10 * i), T0 + timedelta(seconds=10 * i + seconds), f"live{i:08d}.ts") for i in range(first, last)], SCHEMA)


def texts(df):
    return {r.node: r.body for r in df.collect()}


def test_appends_in_any_steps_give_the_whole_text(spark, rows, tmp_path):
    path, whole = str(tmp_path / "pages"), listed(rows, 0, 137)
    pages.store_pages(pages.build_pages(listed(rows, 0, 1), ["node"], 10), path, ["node"])
    for first, last in ((1, 9), (9, 10), (10, 10), (10, 47), (40, 61), (61, 137), (100, 137)):  # names seen before count once
        stored = pages.read_pages(spark, path, KEY)
        pages.store_pages(pages.append_pages(stored, listed(rows, first, last), ["node"], 10), path, ["node"])
    stored = pages.read_pages(spark, path, KEY)
    assert texts(pages.page_texts(stored, ["node"])) == texts(playlist.build_playlist(whole, ["node"]))
    assert sorted(r.n_segments for r in stored.collect()) == [7] + [10] * 13


def test_new_lists_longer_segments_and_copies(spark, rows):
    old = pages.build_pages(listed(rows, 0, 25), ["node"], 10)
    new = listed(rows, 25, 30, seconds=99).unionByName(listed(rows, 0, 12, node=2)).unionByName(listed(rows, 25, 30, seconds=50))
    grown = pages.append_pages(old, new, ["node"], 10)
    assert sorted((r.node, r.page, r.n_segments) for r in grown.collect()) == [(1, 2, 10), (2, 0, 10), (2, 1, 2)]
    both = old.join(grown, ["node", "page"], "left_anti").unionByName(grown)
    first = playlist.build_playlist(listed(rows, 0, 25), ["node"])
    assert texts(pages.page_texts(both, ["node"])) == texts(playlist.append_playlist(first, new, ["node"]))
    assert pages.append_pages(old, new.where("false"), ["node"], 10).count() == 0
    assert texts(pages.page_texts(pages.append_pages(old.where("false"), new, ["node"], 10), ["node"])) == texts(playlist.build_playlist(new, ["node"]))


def test_a_long_list_rewrites_one_page(spark, tmp_path):
    path = str(tmp_path / "pages")
    start = F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    segs = spark.range(1_000_003).select(F.lit(1).cast("bigint").alias("node"), start.alias("seg_start"), (start + F.expr("interval 1 second")).alias("seg_end"),
                                         F.format_string("live%09d.ts", "id").alias("ts_name"))
    pages.store_pages(pages.build_pages(segs.where("ts_name < 'live001000000.ts'"), ["node"]), path, ["node"])

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    assert len(before) == 100
    pages.store_pages(pages.append_pages(pages.read_pages(spark, path, KEY), segs.where("ts_name >= 'live000999990.ts'"), ["node"]), path, ["node"])
    after = files()
    assert len(after) == 101 and all(after[f] == at_ for f, at_ in before.items())  # the last page was full: one new one
    more = segs.where("ts_name = 'live001000002.ts'").withColumn("ts_name", F.lit("last.ts"))
    pages.store_pages(pages.append_pages(pages.read_pages(spark, path, KEY), more, ["node"]), path, ["node"])
    assert sum(f in after for f in files()) == 100 and len(files()) == 101
    got = pages.read_pages(spark, path, KEY).agg(F.sum("n_segments"), F.max("page")).first()
    assert tuple(got) == (1_000_004, 100)
