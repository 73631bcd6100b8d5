"""Long playlists in pages: full pages never change, and an append touches the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.functions.times import us
from segtide.operators import ordered
from segtide.operators.keys import per_key
from segtide.operators.playlist import END, HEADER, TARGET, playlist_lines
from segtide.sources.written import written

PAGE = 10_000  # segments of a page
FIGURES = ["text", "n_segments", "longest", "first_name", "last_name"]


def _pages(ranked: DataFrame, by: list[str], page_rows: int) -> DataFrame:
    """Pages of segments with a ``place`` in their list, from 0."""
    seconds = (us("seg_end") - us("seg_start")) / F.lit(1_000_000)
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return (playlist_lines(ranked).groupBy(*by, F.call_function("div", F.col("place"), F.lit(page_rows)).alias("page"))
            .agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"), F.count("*").alias("n_segments"),
                 F.max(seconds).alias("longest"), F.min("ts_name").alias("first_name"), F.max("ts_name").alias("last_name")))


def _in_order(segments: DataFrame, by: list[str], **kw) -> DataFrame:
    """Each segment once, with its ``rank`` in time order; copies keep the latest end."""
    once = segments.groupBy(*by, "seg_start", "ts_name").agg(F.max("seg_end").alias("seg_end"))
    return ordered.with_rank(once.withColumn("_us", us("seg_start")), by, "_us", ["_us", "ts_name"], **kw).drop("_us")


def build_pages(segments: DataFrame, by: list[str], page_rows: int = PAGE, **kw) -> DataFrame:
    """``by``, ``page`` (from 0), ``text`` (its segments' lines), ``n_segments, longest, first_name, last_name``: no page has more than
    ``page_rows`` segments, so no row or task holds a whole list."""
    return _pages(_in_order(segments, by, **kw).withColumn("place", F.col("rank") - 1), by, page_rows)


def append_pages(pages: DataFrame, segments: DataFrame, by: list[str], page_rows: int = PAGE, **kw) -> DataFrame:
    """The pages that an append makes or changes: the last of each list that grows, and those after it.

    New segments follow the old ones in their own time order. Those whose name is listed already are left out; only pages
    whose names can include a new one are looked through. A list without pages yet gets its first.
    """
    new, _ = written(segments.select(*by, "seg_start", "seg_end", "ts_name"), "new_segments")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in by]
    near = (pages.alias("p").join(new.alias("s"), [*same, F.col("s.ts_name") >= F.col("p.first_name"), F.col("s.ts_name") <= F.col("p.last_name")],
                                  "left_semi"))
    known = near.select(*by, F.explode(F.split("text", "\n")).alias("ts_name")).where(~F.startswith("ts_name", F.lit("#")))
    fresh, _ = written(new.join(known, [*by, "ts_name"], "left_anti"), "fresh_segments")
    tails = per_key(pages.join(per_key(fresh, by), by, "left_semi"), by, F.max_by(F.struct("page", *FIGURES), "page").alias("_tail"))
    tails, _ = written(tails.select(*by, "_tail.*"), "tails")
    begin = tails.select(*by, (F.col("page") * page_rows + F.col("n_segments")).alias("_begin"))
    placed = (_in_order(fresh, by, **kw).join(begin, by, "left")
              .withColumn("place", F.coalesce("_begin", F.lit(0)) + F.col("rank") - 1).drop("_begin"))
    made = _pages(placed, by, page_rows)
    old = tails.select(*by, "page", *[F.col(c).alias(f"_{c}") for c in FIGURES])
    return made.join(old, [*by, "page"], "left").select(
        *by, "page", F.concat_ws("\n", "_text", "text").alias("text"),
        (F.coalesce("_n_segments", F.lit(0)) + F.col("n_segments")).alias("n_segments"),
        F.greatest("_longest", "longest").alias("longest"), F.least("_first_name", "first_name").alias("first_name"),
        F.greatest("_last_name", "last_name").alias("last_name"))


def store_pages(pages: DataFrame, path: str, by: list[str]) -> None:
    """Write pages to a folder each; other pages below ``path`` stay as they are."""
    (pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "page").parquet(path))


def read_pages(spark: SparkSession, path: str, by_schema: str) -> DataFrame:
    """Stored pages; ``by_schema`` declares the list's key columns."""
    return spark.read.schema("text string, n_segments bigint, longest double, first_name string, last_name string, "
                             f"{by_schema}, page bigint").parquet(path)


def page_texts(pages: DataFrame, by: list[str]) -> DataFrame:
    """The whole text of each list, as ``build_playlist`` makes it: for readers that need one text."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    target = F.concat(F.lit(TARGET), F.ceil(F.max("longest")).cast("string"))
    body = F.concat_ws("\n", F.lit(HEADER), target, F.array_join(F.transform(parts, lambda r: r["text"]), "\n"), F.lit(END))
    return pages.groupBy(*by).agg(body.alias("body"))
