"""Byte BPE, token counts and token files against the libraries, on whole texts."""

import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segtide.llm import bitplanes, bpe, counts
from segtide.session import shared_dir
from tests.llm.conftest import pairs, rows_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tiktoken_one():
    import tiktoken
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("table, block", [("messy", 200), ("messy", 40_000_000), ("documents", 50_000), ("no_rows", 100)])
def test_byte_bpe_is_the_librarys_and_comes_back(request, spark, tiktoken_one, table, block):
    docs = request.getfixturevalue(table)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=block)
    decoded = bpe.decode(encoded, bpe.token_table(spark, "file://" + RANKS))
    wanted = [(d, tuple(tiktoken_one(t)), t) for d, t in pairs(docs)]
    got = [(r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded).decode()) for r in decoded.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_ids_as_an_array(spark):
    packed = np.array([1, 50_000, 70_000], "<u4").tobytes()
    df = spark.createDataFrame([(packed,), (b"",), (None,)], "ids binary")
    assert [r[0] for r in df.select(bpe.ids_array()).collect()] == [[1, 50_000, 70_000], [], None]


def test_unknown_id_ends_the_job(spark):
    df = spark.createDataFrame([(1, np.array([999_999], "<u4").tobytes())], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="lacks an id"):
        bpe.decode(df, bpe.token_table(spark, "file://" + RANKS)).collect()


@pytest.mark.parametrize("table, block", [("messy", 300), ("documents", 40_000_000), ("no_rows", 100)])
def test_counts_are_the_librarys(request, word_tokenizer, table, block):
    docs = request.getfixturevalue(table)
    wanted = [(d, len(t.encode()), n := len(word_tokenizer.encode(t, add_special_tokens=False).ids), n > 2048)
              for d, t in pairs(docs)]
    assert rows_of(counts.token_counts(docs, WORDS, block_chars=block)) == sorted(wanted, key=repr)


@pytest.mark.parametrize("table, ids, kind", [("messy", 7, "bit"), ("messy", 65_536, "byte"), ("documents", 500, "byte"),
                                              ("no_rows", 10, "byte")])
def test_files_give_all_ids_back_in_order(request, spark, word_tokenizer, table, ids, kind):
    docs = request.getfixturevalue(table)
    path = shared_dir(spark, "test_tokens")
    bitplanes.write_token_files(docs, path, WORDS, block_ids=ids, plane_kind=kind)
    got = sorted(((r.start, r.doc_id, bytes(r.ids), r.n_tokens) for r in bitplanes.read_token_files(spark, path).collect()),
                 key=lambda r: r[0])
    wanted = [(d, np.array(word_tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in pairs(docs)]
    assert sorted([g[1:3] for g in got], key=repr) == sorted(wanted, key=repr)
    keys = [(g[1] is not None, g[1] or 0) for g in got]
    assert keys == sorted(keys)
    at = 0
    for start, _, packed, n in got:
        assert start == at and len(packed) == 4 * n
        at += n
    index = spark.read.parquet(path + "/index")
    assert index.agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0] == at
    assert all(r.n_ids == ids for r in index.collect() if r.chunk < index.where(F.col("shard") == r.shard).count() - 1)


def test_checksum_is_of_the_packed_ids(spark):
    packed = np.array([5, 6], "<u4").tobytes()
    df = spark.createDataFrame([(1, 0, 2, packed)], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    assert bitplanes.digest(df).first().ids_crc32 == zlib.crc32(packed)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind) == ids).all()
