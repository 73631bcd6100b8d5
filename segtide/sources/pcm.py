"""Sample arrays to PCM WAV payloads and back.

Spark partitions the work; a task turns one Arrow batch of arrays into bytes at a time.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The canonical 44-byte header of a 16-bit PCM WAV file.
HEADER = "<4sI4s4sIHHIIHH4sI"
HEADER_SIZE = 44
FULL_SCALE = 32767
# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAMES_SCHEMA = "path string, rate int, channels int, samples array<float>, error string"


def _encode(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """Interleaved samples in [-1, 1] as little-endian 16-bit PCM; louder ones are clipped."""
    scaled = np.floor(np.asarray(samples, dtype="float64") * FULL_SCALE + 0.5)
    body = np.clip(scaled, -FULL_SCALE - 1, FULL_SCALE).astype("<i2").tobytes()
    width = 2 * channels
    head = struct.pack(HEADER, b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * width,
                       width, 16, b"data", len(body))
    return head + body


def _decode(content: bytes) -> tuple[int, int, np.ndarray]:
    if len(content) < HEADER_SIZE:
        raise ValueError("shorter than a header")
    riff, _, wave, fmt, _, codec, channels, rate, _, _, bits, data, size = struct.unpack_from(HEADER, content)
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data"):
        raise ValueError("not a canonical WAV file")
    if codec != 1 or bits != 16 or channels < 1 or rate < 1:
        raise ValueError("not 16-bit PCM")
    if size != len(content) - HEADER_SIZE or size % (2 * channels):
        raise ValueError("cut short")
    body = np.frombuffer(content, dtype="<i2", offset=HEADER_SIZE)
    return rate, channels, (body / np.float64(FULL_SCALE)).astype("float32")


def pcm_write(frames: DataFrame, key: str, samples: str, rate: int, channels: int = 1) -> DataFrame:
    """``path`` and ``content`` of one WAV payload per row of ``frames``."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"],
                                "content": [_encode(s, rate, channels) for s in pdf["samples"]]})

    rows = frames.select(F.col(key).cast("string").alias("path"), F.col(samples).alias("samples"))
    return rows.mapInPandas(encode, "path string, content binary")


def pcm_decode(files: DataFrame) -> DataFrame:
    """Frames of payloads (``path``, ``content``, as the binary file source gives), or the ``error`` of one that cannot
    be decoded; for tables and streams."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rate, channels, values = _decode(bytes(content))
                    rows.append((path, rate, channels, values, None))
                except ValueError as why:
                    rows.append((path, None, None, None, str(why)))
            out = pd.DataFrame(rows, columns=["path", "rate", "channels", "samples", "error"])
            yield out.astype({"rate": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(decode, FRAMES_SCHEMA)


def pcm_read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of payloads, and a quarantine of those that cannot be decoded, with the reason."""
    decoded = pcm_decode(files)
    return decoded.where("error is null").drop("error"), decoded.where("error is not null").select("path", "error")
