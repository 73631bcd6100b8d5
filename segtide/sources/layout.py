"""Partitioned tables: catalogues by day, outputs by node, kind and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ("node", "kind", "run_id")


def write_layout(df: DataFrame, path: str, by: tuple[str, ...] = LAYOUT, mode: str = "overwrite") -> str:
    """Write one folder per value of ``by``.

    The rebalance hint gathers the rows of a folder, so that it gets few files, and still splits
    a folder that holds very many rows over several tasks.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)
    return path


def read_layout(spark: SparkSession, path: str, schema: str, **only: list) -> DataFrame:
    """Read a layout; ``only`` names the folders wanted and prunes the others unread."""
    df = spark.read.schema(schema).parquet(path)
    for column, values in only.items():
        df = df.where(F.col(column).isin(list(values)))
    return df


def write_days(catalog: DataFrame, path: str) -> str:
    """Catalogue laid out by day of the file time."""
    return write_layout(catalog.withColumn("day", F.date_format("file_time", "yyyy-MM-dd")), path, ("day",))


def scan_days(spark: SparkSession, path: str, days: list[str], schema: str) -> DataFrame:
    return read_layout(spark, path, schema, day=days)


def scan_planned_days(spark: SparkSession, path: str, plan: DataFrame, schema: str) -> DataFrame:
    """Rows of a day layout on the days of a plan (``plan_listing_days``).

    The days are found while the query runs, and the folders of other days are left unread: dynamic partition
    pruning, which Spark only tries if the small side has a comparison.
    """
    wanted = plan.select(F.date_format("day", "yyyy-MM-dd").alias("day")).where("day >= ''").distinct()
    return read_layout(spark, path, schema).join(wanted, "day", "left_semi")
