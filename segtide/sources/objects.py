"""Files as objects: written, copied and moved one by one on the executors, in two phases.

First every object is copied, and a manifest says for each whether that went well; then, out of the written manifest,
the sources of those that did are deleted. An object that fails keeps its source. Rows carry paths only; contents
go from store to store in pieces. Paths are URIs or plain paths of a store all executors reach.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segtide.sources.sinks import batch_sink, read_batches, write_batch

PIECE = 8 << 20
STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
COPIED = "source string, target string, n_bytes bigint, error string"
DELETED = "source string, target string, deleted boolean, error string"
# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@cache
def _store(root: str):
    return pyarrow.fs.FileSystem.from_uri(root)[0]


def _at(uri: str):
    """The store of a path, and the path in it."""
    if ":/" not in uri:
        return _store("file:///"), uri
    if uri.startswith("file:"):
        return _store("file:///"), "/" + uri[5:].lstrip("/")
    scheme, rest = uri.split("://", 1)
    authority = rest.split("/", 1)[0]
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    return (_store(f"{scheme}://{authority}/") if scheme == "hdfs" else store), path


def _size(uri: str) -> int | None:
    """Bytes of a file; None where there is none."""
    store, path = _at(uri)
    info = store.get_file_info(path)
    return info.size if info.type == pyarrow.fs.FileType.File else None


def _put(pieces: Iterator[bytes], target: str) -> int:
    """Write beside the target, then rename: readers never see half an object."""
    store, path = _at(target)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    n = 0
    try:
        with store.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
                n += len(piece)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type == pyarrow.fs.FileType.File:
            store.delete_file(part)
        raise
    return n


def _pieces(source: str) -> Iterator[bytes]:
    store, path = _at(source)
    with store.open_input_stream(path) as stream:
        while piece := stream.read(PIECE):
            yield piece


def _copy(source: str, target: str) -> int:
    if _size(source) is None and (n := _size(target)) is not None:
        return n  # an earlier try of this batch got further
    return _put(_pieces(source), target)


def _each(rows: DataFrame, work: Callable[..., tuple], schema: str, *columns: str) -> DataFrame:
    """One result row per row; ``work`` gets the columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [work(*row) for row in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in results], schema=arrow)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in schema.split(", ")])
    return rows.select(*columns).mapInArrow(run, schema)


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def put_objects(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Write the binary ``content`` of each row to its ``path``; returns ``source`` (null), ``target, n_bytes, error``."""
    def put(target: str | None, data: bytes | None) -> tuple:
        try:
            if target is None or data is None:
                raise ValueError("no path or no content")
            return None, target, _put(iter([bytes(data)]), target), None
        except Exception as error:  # reported per object
            return None, target, None, _reason(error)

    return _each(rows, put, COPIED, path, content)


def copy_objects(moves: DataFrame) -> DataFrame:
    """Copy each ``source`` to its ``target``: ``source, target, n_bytes, error``, one row per pair.

    Of several sources with one target only the smallest is copied; the others report it, as do rows without a target, and
    files that can't be read or written. A source that is gone while its target is there counts as copied before.
    """
    pairs = moves.select("source", "target").where("source is not null").distinct()
    aimed = pairs.where("target is not null")
    first = F.col("source") == F.min("source").over(W.partitionBy("target"))
    marked = aimed.withColumn("why", F.when(~first, "another source has this target")).unionByName(
        pairs.where("target is null").withColumn("why", F.lit("no target")))

    def copy(source: str, target: str | None, why: str | None) -> tuple:
        if why is not None:
            return source, target, None, why
        try:
            return source, target, _copy(source, target), None
        except Exception as error:  # reported per object, and the source stays
            return source, target, None, _reason(error)

    spread = marked.repartition(moves.sparkSession.sparkContext.defaultParallelism, F.xxhash64("source"))
    return _each(spread, copy, COPIED, "source", "target", "why")


def delete_sources(copied: DataFrame) -> DataFrame:
    """Delete the sources of a written manifest whose targets are there in full: ``source, target, deleted, error``."""
    def delete(source: str, target: str, n_bytes: int) -> tuple:
        try:
            if _size(target) != n_bytes:
                raise ValueError("the target isn't there in full")
            if _size(source) is not None:
                store, path = _at(source)
                store.delete_file(path)
            return source, target, True, None
        except Exception as error:  # reported per object, and the source stays
            return source, target, False, _reason(error)

    return _each(copied.where("error is null"), delete, DELETED, "source", "target", "n_bytes")


def move_batch(moves: DataFrame, manifest: str, batch_id: int) -> None:
    """Both phases for one batch. A repeated batch replaces its manifest and goes on where the first try ended."""
    spark = moves.sparkSession
    write_batch(copy_objects(moves), f"{manifest}/copied", batch_id)
    copied = spark.read.schema(COPIED).parquet(f"{manifest}/copied/batch_id={batch_id}")
    write_batch(delete_sources(copied), f"{manifest}/deleted", batch_id)


def move_sink(moves: DataFrame, manifest: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Move the objects of a stream of ``source, target``: see ``move_batch``. Failures stay in the manifest, and their
    sources where they are."""
    return batch_sink(moves, lambda batch, i: move_batch(batch, manifest, i), checkpoint, every=every)


def moved(spark: SparkSession, manifest: str) -> DataFrame:
    """What a move sink has done so far: ``source, target, n_bytes, error, deleted, batch_id``."""
    copied = read_batches(spark, f"{manifest}/copied", COPIED)
    deleted = read_batches(spark, f"{manifest}/deleted", DELETED).select("batch_id", "source", "target", "deleted", F.col("error").alias("_why"))
    return copied.join(deleted, ["batch_id", "source", "target"], "left").select(
        "source", "target", "n_bytes", F.coalesce("error", "_why").alias("error"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "batch_id")


def list_objects(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below a folder, other than empty ones: ``path`` (below the folder), ``length`` and, if asked for, ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # both as paths without store and host
    bare = re.sub(STORE, "", root).rstrip("/") + "/"
    return files.select(F.substring(F.regexp_replace("path", STORE, ""), F.lit(len(bare) + 1), F.length("path")).alias("path"),
                        "length", *(["content"] if content else []))
