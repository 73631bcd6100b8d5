"""Byte-level BPE by rank files: distinct pre-tokens are encoded once, documents are put together by position."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from segtide.llm.tables import binary_pieces, one_thread, ragged_take, release_memory, ship, starts, unpack
from segtide.llm.words import BLOCK_CHARS, once_per_word, values_in_order, word_blocks

#: White space of the pattern language (the Unicode property), as text.
SPACE = "\t-\r \x85\xa0  -     　"
MAX_VOCABULARY = 1_000_000  # entries of a token table that may be handed to every task


def _splitter(pattern: str):
    """Pre-tokens of a text, in order.

    No match of the pattern goes from a character that isn't white space to one that is, so the text
    falls apart at these places, and repeated pieces are matched once per block.
    """
    import regex
    match = regex.compile(pattern).findall
    odd_space = re.compile(f"[{SPACE}] ").search  # a space that follows other white space starts no piece
    pieces_of = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall

    def open_block():
        known: dict[str, tuple[int, ...]] = {}

        def split(text: str, seen) -> list[int]:
            if not text:
                return []
            if odd_space(text):
                pieces = pieces_of(text)
            else:
                first, *rest = text.split(" ")
                pieces = ([first] if first else []) + [" " + w for w in rest]
            out: list[int] = []
            for piece in pieces:
                numbers = known.get(piece)
                if numbers is None:
                    if len(known) >= 200_000:  # only saves work: may start again
                        known.clear()
                    known[piece] = numbers = tuple([seen[m.encode()] for m in match(piece)])
                out += numbers
            return out

        return split

    return open_block


@cache
def _encoding(path: str, pattern: str):
    one_thread()
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of every whole text, each match of ``pattern`` encoded by itself, no special tokens.

    Distinct pre-tokens are shuffled by their bytes and encoded once in the whole corpus; their
    ids go back to the blocks they came from, where documents are put together by position.

    Returns ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit numbers; ``ids_array`` makes an
    array of them), one row for each input row: repeated rows and ids give repeated rows, a null id stays
    null, a null or empty text has no ids, other columns are ignored.
    """
    blocks = word_blocks(docs, "bpe_encode", _splitter(pattern), block_chars=block_chars)

    with open(ranks_path, "rb") as lines:
        wide = max((int(x.split()[1]) for x in lines if x.strip()), default=0) > 0xFFFF
    stored = "<u4" if wide else "<u2"

    def encode_words(words: list[bytes]) -> list[bytes]:
        one = _encoding(ranks_path, pattern).encode_ordinary
        return [np.array(one(w.decode()), dtype=stored).tobytes() for w in words]

    ids = once_per_word(blocks, encode_words)

    def put_together(docs_of: pa.Table, ids_of: pa.Table) -> pa.Table:
        out = []
        flat, offsets = values_in_order(ids_of.column("value"))
        del ids_of
        flat, offsets = flat.view(stored).astype("<u4"), offsets // np.dtype(stored).itemsize
        for row in docs_of.to_pylist():
            picks, ends = unpack(row["picks"]), starts(np.array(row["lengths"], dtype=np.int64))
            low = 0
            while low < len(ends) - 1:  # a million words at a time
                high = max(int(np.searchsorted(ends, ends[low] + 1_000_000, "right")) - 1, low + 1)
                tokens, lengths = ragged_take(flat, offsets, picks[ends[low]:ends[high]])
                at = starts(lengths)[ends[low:high + 1] - ends[low]]
                out.append(pa.table([pa.array(row["doc_ids"][low:high], pa.int64()), pa.array(np.diff(at)),
                                     binary_pieces(tokens, at * 4)], names=["doc_id", "n_tokens", "ids"]))
                low = high
        del flat, offsets
        release_memory()
        return pa.concat_tables(out) if out else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()),
             "ids": pa.array([], pa.binary())})

    held = blocks.select("block", "doc_ids", "lengths", "picks")
    return held.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        put_together, "doc_id bigint, n_tokens bigint, ids binary")


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(id, bytes) of a rank file, as Spark reads it."""
    parts = F.split("value", " ")
    return spark.read.text(ranks_path).select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("bytes"))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``decoded`` (binary) to rows with packed ``ids``, by a map-side join with the token-byte table.

    The table goes to every task; it is refused above ``MAX_VOCABULARY`` entries. Null ids decode
    to null, no ids to no bytes, an id that the table lacks ends the job.
    """
    ship(encoded)
    if "decoded" in encoded.columns:
        encoded = encoded.drop("decoded")
    rows = table.select("id", "bytes").limit(MAX_VOCABULARY + 1).toArrow()
    if rows.num_rows > MAX_VOCABULARY:
        raise ValueError(f"a token table may have {MAX_VOCABULARY} entries at most")
    pieces: list[bytes | None] = [None] * (max(rows.column("id").to_pylist(), default=-1) + 1)
    for number, piece in zip(rows.column("id").to_pylist(), rows.column("bytes").to_pylist()):
        pieces[number] = piece
    lacking = np.array([p is None for p in pieces], dtype=bool)
    shared = encoded.sparkSession.sparkContext.broadcast(
        (np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8), starts(np.array([len(p or b"") for p in pieces])),
         lacking))
    at = encoded.columns.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets, missing = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # bounds the bytes made at once
                part = batch.slice(low, 256)
                decoded = []
                for ids in part.column(at):
                    if not ids.is_valid:
                        decoded.append(None)
                        continue
                    picks = np.frombuffer(ids.as_buffer(), "<u4")
                    if len(picks) and (picks.max() >= len(missing) or missing[picks].any()):
                        raise ValueError("the token table lacks an id")
                    decoded.append(ragged_take(flat, offsets, picks)[0].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())],
                                                 names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(work, StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def ids_array(packed: str = "ids"):
    """Column: packed little-endian ids as an array of whole numbers."""
    text = F.hex(packed)
    at = F.sequence(F.lit(0), F.greatest(F.length(packed) / 4 - 1, F.lit(0)).cast("int"))
    one = F.transform(at, lambda i: F.conv(F.concat(*[F.substring(text, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10)
                      .cast("bigint"))
    return F.when(F.col(packed).isNotNull(), F.when(F.length(packed) == 0, F.array().cast("array<bigint>")).otherwise(one))
