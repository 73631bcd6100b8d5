"""Token counts: pieces of each distinct pre-token, joined to the pre-token frequencies of documents."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segtide.llm.tables import one_thread, starts, unpack
from segtide.llm.words import BLOCK_CHARS, once_per_word, values_in_order, word_blocks


def _split_on_space():
    """Runs between ASCII white space: no pre-token and no special string crosses it."""
    return lambda text, seen: [seen[w] for w in text.encode().split()]


@cache
def _json_tokenizer(path: str):
    one_thread()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Tokens of every whole text, by the tokenizers library and a ``.json`` file that drops white space.

    The pieces of each distinct pre-token (a run between ASCII white space) are counted once in the
    whole corpus, joined to the frequencies of the documents' pre-tokens, and summed; no
    ids are kept. Special strings inside texts count as the library takes them by default.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens), one row for each
    input row: repeated rows and ids give repeated rows, a null id stays null, a null or
    empty text has no bytes and no tokens, other columns are ignored.
    """
    blocks = word_blocks(docs, "token_counts", _split_on_space, frequencies=True, block_chars=block_chars)

    def count_pieces(words: list[bytes]) -> list[bytes]:
        encoded = _json_tokenizer(tokenizer_path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [len(e).to_bytes(4, "little") for e in encoded]

    pieces = once_per_word(blocks, count_pieces)

    def total(docs_of: pa.Table, pieces_of: pa.Table) -> pa.Table:
        out = []
        per_word = values_in_order(pieces_of.column("value"))[0].view("<u4").astype(np.int64)
        for row in docs_of.to_pylist():
            ends = starts(np.array(row["lengths"], dtype=np.int64))
            sums = starts(per_word[unpack(row["picks"])] * unpack(row["times"]))
            tokens = sums[ends[1:]] - sums[ends[:-1]]
            out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()),
                                 pa.array(tokens), pa.array(tokens > limit)],
                                names=["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        return pa.concat_tables(out) if out else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
             "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_())})

    held = blocks.select("block", "doc_ids", "lengths", "n_bytes", "picks", "times")
    return held.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(
        total, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
