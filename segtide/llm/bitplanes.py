"""Token-id files: ids of all documents in order, in fixed-size blocks stored as compressed byte or bit planes."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.llm.tables import binary_pieces, one_thread, ragged_take, ship, shuffle_partitions, starts

BLOCK_IDS = 65_536
CHUNKS = ("shard int, chunk int, first_id bigint, n_ids int, planes array<binary>, plane_kind string, "
          "pieces array<struct<doc_id bigint, row bigint, piece int, of int, place int, n int>>")


class WordEncoder:
    """Encodes many texts by the tokenizers library, each distinct pre-token of a group once.

    For vocabularies whose pre-tokenizer drops white space and whose pieces mark the end of a pre-token (``</w>``): texts
    fall apart at ASCII white space, and the ids of many pre-tokens encoded as one text fall apart at the marks. Anything unusual
    (special strings, letters outside the Latin blocks) goes through the library as it stands.
    """

    def __init__(self, path: str):
        one_thread()
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, number in vocabulary.items():
            self.ends[number] = piece.endswith("</w>")
        self.pretokens = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[\n\x21-\x7e\xa1-įĲ-ž]*").fullmatch  # one lower-case form, composed already
        self.forget()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of distinct pre-tokens, many to a call, and how many each has; both in parts."""
        ids_of, sizes = [], []
        for low in range(0, len(words), 1000):
            group = words[low:low + 1000]
            ids = np.array(self._encode([" ".join(group)])[0], dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                sizes.append(np.diff(cuts, prepend=0))
            else:  # a pre-token came apart otherwise: one by one
                each = self._encode(group)
                ids = np.array([i for x in each for i in x], dtype=np.uint32)
                sizes.append(np.array([len(x) for x in each], dtype=np.int64))
            ids_of.append(ids)
        return ids_of, sizes

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and where each begins. Pre-tokens are remembered.

        Words are cut many at a time, with a line break behind each (piece 0, without ids); a word that needs the
        library as it stands is one piece, marked by a zero character.
        """
        def usual(text: str) -> bool:
            return self.plain(text) is not None and not any(s in text for s in self.specials)

        base, parts = len(self.piece_offsets) - 1, []
        for low in range(0, len(words), 1000):
            group = words[low:low + 1000]
            text = "\n".join(group)
            if usual(text):
                parts += self.pretokens(text.lower() + "\n")
            else:
                for word in group:
                    parts += self.pretokens(word.lower()) if usual(word) else [ODD + word]
                    parts.append("\n")
        numbers = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        new = list(islice(self.pieces, base, None))
        odd = np.array([p[0] == ODD for p in new], dtype=bool)
        ids, sizes = self._pretokens([p for p in new if p[0] != ODD])
        encoded = self._encode([p[1:] for p in new if p[0] == ODD])
        ids += [np.array(x, dtype=np.uint32) for x in encoded]
        sizes.append(np.array([len(x) for x in encoded], dtype=np.int64))
        place = np.argsort(np.argsort(odd, kind="stable"), kind="stable")  # usual pieces came before odd ones
        flat, lengths = ragged_take(np.concatenate(ids) if ids else np.empty(0, np.uint32), starts(np.concatenate(sizes)), place)
        self.piece_flat = np.concatenate([self.piece_flat, flat])
        self.piece_offsets = np.concatenate([self.piece_offsets, self.piece_offsets[-1] + np.cumsum(lengths)])
        flat, lengths = ragged_take(self.piece_flat, self.piece_offsets, numbers)
        return flat, starts(lengths)[np.concatenate([[0], np.flatnonzero(numbers == 0) + 1])]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each begins. Words are remembered, up to ``MEMORY`` of them."""
        if len(self.seen) > MEMORY:
            self.forget()
        picks = []
        for text in texts:
            words = text.encode().split()
            picks.append(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)))
        new = [w.decode() for w in islice(self.seen, len(self.offsets) - 1, None)]
        flat, offsets = self.words(new)
        self.flat = np.concatenate([self.flat, flat])
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        ids, lengths = ragged_take(self.flat, self.offsets, np.concatenate(picks) if picks else np.empty(0, np.int64))
        return ids, starts(lengths)[starts(np.array([len(p) for p in picks], dtype=np.int64))]

    def forget(self) -> None:
        self.seen: defaultdict = defaultdict(count().__next__)
        self.flat, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.pieces: defaultdict = defaultdict(count().__next__)
        self.pieces["\n"]
        self.piece_flat, self.piece_offsets = np.empty(0, np.uint32), np.zeros(2, np.int64)


ODD = "\0"
MEMORY = 500_000  # words a worker remembers between groups of texts


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """One zstandard frame for each byte plane (or bit plane) of little-endian 32-bit ids."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = octets.T if kind == "byte" else np.packbits(
        np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if not n:
        return np.empty(0, "<u4")
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, block_ids: int = BLOCK_IDS,
                      plane_kind: str = "byte", text_chars: int = 8_000_000) -> None:
    """Encode every whole text, add ``end_id``, and write all ids in ascending ``doc_id`` order below ``path``.

    ``path/chunks`` holds a row for each block of ``block_ids`` ids of a shard: its planes and which document pieces lie
    in it; ``path/index`` the chunk index: shard, chunk, global place of its first id, ids, bytes stored. Shards are
    ranges of doc_id (then of text, so equal ids keep one order); null ids come first, a null text is empty. Tasks
    write through Spark's committer, so a lost executor's shard is written again by another.
    """
    if plane_kind not in ("byte", "bit"):
        raise ValueError("plane_kind is byte or bit")
    ship(docs)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        encoder = _encoder(tokenizer_path)
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= text_chars:
                    yield ids, *encoder.texts(texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, *encoder.texts(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, row, done = TaskContext.get().partitionId(), 0, 0, 0
        held, pieces, size = [], [], 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([len(values)], pa.int32()), pa.array([to_planes(values, plane_kind)], pa.list_(pa.binary())),
                 pa.array([plane_kind]), pa.array([pieces], _PIECES)],
                names=["shard", "chunk", "first_id", "n_ids", "planes", "plane_kind", "pieces"])

        for doc_ids, flat, ends in encode(batches):
            for k, doc in enumerate(doc_ids):
                ids = flat[ends[k]:ends[k + 1]]
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                at, piece = 0, 0
                of = 1 + max(0, len(ids) - (block_ids - size) + block_ids - 1) // block_ids if len(ids) > block_ids - size else 1
                while True:
                    take = min(len(ids) - at, block_ids - size)
                    pieces.append({"doc_id": doc, "row": row, "piece": piece, "of": of, "place": size, "n": take})
                    held.append(ids[at:at + take])
                    at, size, piece = at + take, size + take, piece + 1
                    if size == block_ids:
                        yield close()
                        done += size
                        held, pieces, size, chunk = [], [], 0, chunk + 1
                    if at >= len(ids):
                        break
                row += 1
        if pieces:
            yield close()

    rows.mapInArrow(work, CHUNKS).write.parquet(os.path.join(path, "chunks"))
    spark = docs.sparkSession
    chunks = spark.read.schema(CHUNKS).parquet(os.path.join(path, "chunks"))
    stored = F.aggregate("planes", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p))
    index = chunks.select("shard", "chunk", "first_id", "n_ids", stored.alias("stored_bytes"))
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("_ids")).orderBy("shard").collect()  # one row for each task's file
    base, before = [], 0
    for r in totals:
        base.append((r["shard"], before))
        before += r["_ids"]
    bases = spark.createDataFrame(base, "shard int, _base bigint")
    (index.join(bases, "shard").withColumn("first_id", F.col("first_id") + F.col("_base")).drop("_base")
     .write.parquet(os.path.join(path, "index")))


_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("of", pa.int32()),
                              ("place", pa.int32()), ("n", pa.int32())]))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents read back: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids`` (packed, little-endian).

    Blocks are decoded each by itself; only documents that lie across blocks are gathered, by document.
    """
    index = spark.read.schema("shard int, chunk int, first_id bigint, n_ids int, stored_bytes bigint").parquet(
        os.path.join(path, "index")).select("shard", "chunk", F.col("first_id").alias("_first"))
    chunks = spark.read.schema(CHUNKS).parquet(os.path.join(path, "chunks")).join(index, ["shard", "chunk"])
    chunks = chunks.select("shard", "_first", "n_ids", "planes", "plane_kind", "pieces")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, p = from_planes(r["planes"], r["n_ids"], r["plane_kind"]), r["pieces"]
                at = np.array([x["place"] for x in p] + [r["n_ids"]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(p), pa.int32()), pa.array([x["row"] for x in p], pa.int64()),
                     pa.array([x["doc_id"] for x in p], pa.int64()), pa.array([x["piece"] for x in p], pa.int32()),
                     pa.array([x["of"] for x in p], pa.int32()), pa.array(r["_first"] + at[:-1]), pa.array(np.diff(at)),
                     binary_pieces(ids, at * 4)],
                    names=["shard", "row", "doc_id", "piece", "of", "start", "n_tokens", "ids"])

    pieces = chunks.mapInArrow(work, "shard int, row bigint, doc_id bigint, piece int, of int, start bigint, "
                                     "n_tokens bigint, ids binary")
    whole = pieces.where("of = 1").select("doc_id", "start", "n_tokens", "ids")
    cut = pieces.where("of > 1").groupBy("shard", "row", "doc_id").agg(
        F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("_parts"))
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", _joined("_parts").alias("ids")))


def _joined(parts: str):
    """One binary from sorted (piece, ids)."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))


def digest(documents: DataFrame) -> DataFrame:
    """``ids`` as a checksum: unsigned CRC-32 of the packed ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
