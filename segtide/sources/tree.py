"""New files below a folder tree, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


FILE = "path string, modificationTime timestamp, length bigint, content binary"  # fixed value: the columns of Spark's binary file source


def watch_tree(spark: SparkSession, path: str, schema: str, pattern: str | None = None,
               files_per_trigger: int | None = None, delete_done: bool = False) -> DataFrame:
    """Stream the rows of parquet files that appear anywhere below ``path``.

    With ``delete_done`` a file is deleted once a later batch has been committed, that is, only
    after its rows are safely written.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if delete_done:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(path)


def watch_files(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files of any kind that appear below ``path``: ``path, modificationTime, length, content``; contents are
    only read where a query uses them. Spark gives no row for an empty file."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
