"""Tables that cut lineage, and small helpers for Arrow tasks."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

import segtide
from segtide.session import shared_dir

_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Hand this package to the executors once per application, so that tasks can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(segtide.__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="segtide-package-"), f"segtide_{uuid.uuid4().hex}")
        context.addPyFile(shutil.make_archive(archive, "zip", root, "segtide"))
        _shipped.add(context.applicationId)


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write below the shared folder and read back: later steps, and lost executors, start from the files."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As ``write_shared``, laid out by a hash of ``key``: a later join or grouping by it moves nothing."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, label))
     .bucketBy(buckets, key).saveAsTable(name))
    return spark.table(name)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def one_thread() -> None:
    """Native tokenizer libraries must not start threads beside Spark's own tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def release_memory() -> None:
    """Give freed memory back to the machine: workers are kept for later stages, which need theirs beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, mostly small, under zstandard: a byte each, and byte planes of those from 255 on."""
    values = np.ascontiguousarray(values, dtype="<u4")
    large = values[values >= 255]
    planes = np.ascontiguousarray(large.view(np.uint8).reshape(-1, 4).T)
    small = np.minimum(values, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(len(values).to_bytes(8, "little") + small.tobytes() + planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = raw[8:8 + n].astype("<u4")
    out[out == 255] = np.ascontiguousarray(raw[8 + n:].reshape(4, -1).T).view("<u4").ravel()
    return out


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive pieces: one more than there are pieces."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ragged_take(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[offsets[i]:offsets[i + 1]]`` of all picks in a row, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    at += np.repeat(offsets[:-1][picks] - ends + lengths, lengths)
    return flat[at], lengths


def binary_pieces(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive pieces of a byte array (below 2 GB) as Arrow binaries, without a Python object for each."""
    flat = np.ascontiguousarray(flat).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def documents_in(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """Groups of (ids, texts) of about ``chars`` characters each; a null text is empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= chars or len(ids) >= 100_000:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
    del ids, texts
    release_memory()
