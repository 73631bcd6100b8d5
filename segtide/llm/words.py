"""Distinct words of blocks of documents, worked on once each in the whole corpus.

Documents are read once, in blocks of bounded size. A block keeps its documents as numbers of its
own distinct words (positions stay implicit), and only the distinct words of each block travel:
one shuffle by word brings the copies of a word together, sorted, so that it is worked on once and
its result is joined to all its copies in the same pass. Results go back by block and meet
the documents there; the blocks are laid out by block number, so the documents are never shuffled.
A frequent word has one copy per block at most, whatever its count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.tables import pack, release_memory, ship, shuffle_partitions, write_bucketed

BLOCK_CHARS = 40_000_000  # text of one block; a longer document is a block of its own
# A word's place is one number: task, block of the task, place in the block.
NUMBER_BITS, IDX_BITS = 14, 28

BLOCKS = ("block bigint, doc_ids array<bigint>, lengths array<bigint>, n_bytes array<bigint>, "
          "picks binary, times binary, words array<binary>")


class _Block:
    """Documents of a block, as numbers of its distinct words."""

    def __init__(self, splitter: Callable[[], Callable]):
        self.seen: defaultdict = defaultdict(count().__next__)
        self.split = splitter()
        self.ids, self.n_bytes, self.picks, self.chars = [], [], [], 0

    def add(self, doc: int | None, text: str) -> None:
        self.ids.append(doc)
        self.n_bytes.append(len(text.encode()))
        self.picks.append(np.asarray(self.split(text, self.seen), dtype=np.uint32))
        self.chars += len(text) + 100

    def close(self, block: int, frequencies: bool) -> pa.RecordBatch:
        words, size = list(self.seen), max(len(self.seen), 1)
        if size >> IDX_BITS:
            raise ValueError("too many distinct words in one document")
        lengths = np.array([len(p) for p in self.picks], dtype=np.int64)
        flat, times = np.concatenate(self.picks), b""
        self.picks = self.split = self.seen = None
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words))
        flat = rank[flat]
        if frequencies:
            keys, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + flat, return_counts=True)
            lengths = np.bincount(keys // size, minlength=len(lengths))
            flat, times = keys % size, pack(n)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([self.ids], longs), pa.array([lengths.tolist()], longs), pa.array([self.n_bytes], longs),
             pa.array([pack(flat)]), pa.array([times]), pa.array([[words[i] for i in order]], pa.list_(pa.binary()))],
            names=["block", "doc_ids", "lengths", "n_bytes", "picks", "times", "words"])


def word_blocks(docs: DataFrame, label: str, splitter: Callable[[], Callable], frequencies: bool = False,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The table of blocks of ``docs`` (doc_id, text).

    ``splitter()`` is called once per block and gives ``(text, seen) -> list of word numbers``,
    where ``seen`` numbers new words. With ``frequencies`` a document keeps its distinct words and
    how often each occurs (``times``), else every word in order.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << NUMBER_BITS
        last = block + (1 << NUMBER_BITS)
        held = _Block(splitter)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(doc, text.as_py() or "")
                if held.chars >= block_chars:
                    yield held.close(block, frequencies)
                    block, held = block + 1, _Block(splitter)
                    release_memory()
                    if block == last:
                        raise ValueError("too many blocks in one task: read the documents in smaller splits")
        if held.ids:
            yield held.close(block, frequencies)
        del held
        release_memory()

    ship(docs)
    blocks = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, BLOCKS)
    return write_bucketed(blocks, label, "block", shuffle_partitions(docs))


def once_per_word(blocks: DataFrame, work: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, value): ``work`` runs once on each distinct word of all blocks together; each value begins with the
    word's place in its block, as four bytes (``values_in_order`` puts them in order)."""
    words = blocks.select("block", F.posexplode("words").alias("idx", "word"))
    words = words.select((F.shiftleft("block", IDX_BITS) + F.col("idx")).alias("at"), "word")
    words = words.repartition(shuffle_partitions(blocks), "word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, b""
        for batch in batches:
            word = batch.column("word").dictionary_encode()
            distinct = word.dictionary.to_pylist()
            if not distinct:
                continue
            known = distinct[0] == last  # copies of a word may go on in the next batch
            values = ([held] if known else []) + work(distinct[1:] if known else distinct)
            last, held = distinct[-1], values[-1]
            at = batch.column("at").to_numpy()
            places = (at & ((1 << IDX_BITS) - 1)).astype("<u4")
            flat = places.tobytes()
            joined = [flat[4 * i:4 * i + 4] + values[k] for i, k in enumerate(word.indices.to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array(at >> IDX_BITS), pa.array(joined, pa.binary())], names=["block", "value"])
            del word, distinct, values, joined
        release_memory()

    return words.mapInArrow(run, "block bigint, value binary")


def values_in_order(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``work`` made of a block's words, in the words' order: all bytes in a row, and where each begins."""
    parts = [c for c in column.chunks if len(c)]
    flat, offsets, base = [], [], 0
    for c in parts:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1].astype(np.int64)
        flat.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0]:ends[-1]])
        offsets.append(ends[:-1] - ends[0] + base)
        base += ends[-1] - ends[0]
    if not parts:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data, begins = np.concatenate(flat), np.concatenate([*offsets, [base]])
    places = sum(data[begins[:-1] + i].astype(np.int64) << (8 * i) for i in range(4))
    order = np.argsort(places)
    body = np.stack([begins[:-1] + 4, begins[1:]])[:, order]
    lengths = body[1] - body[0]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1], dtype=np.int64) + np.repeat(body[0] - ends + lengths, lengths)
    return data[at], np.concatenate([[0], ends])
