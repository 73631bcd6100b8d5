"""Removal of repeated byte strings by sorted suffixes.

Every window of ``LENGTH`` bytes belongs to one anchor: the k-gram of smallest hash inside it. Equal windows have equal
anchors at equal places, so only texts around anchors that occur twice are ever compared. Consecutive windows of one
anchor form a chunk; a chunk whose like stands earlier is removed whole. What is left, the edges of repeats,
is settled by suffix sorting: chunks are range-partitioned by the leading bytes at their anchor (Spark samples the
splitters), the suffixes at all their window starts are sorted by multikey quicksort, and runs of equal suffixes
show what repeats. One anchor's chunks never lie on two sides of a splitter. An anchor with very many different chunks
(a short common phrase) is ranged by its whole suffixes instead, together with their places: there a run may cross
splitters, so the heads of the ranges are compared once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.superminhash import mix
from segtide.llm.tables import ship, shuffle_partitions, write_bucketed, write_shared

LENGTH, GRAM = 100, 36
STEP = 1 << 20  # bytes hashed at once
_LOW = np.uint64(STEP - 1)
_P = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (_P, pow(_P, -1, 1 << 64)):
            _POWERS.append(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(
                np.full(STEP - 1, base, dtype=np.uint64))]))
    return _POWERS


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * down[:len(data)], dtype=np.uint64)])
    n = len(data) - GRAM + 1
    return mix((sums[GRAM:] - sums[:-GRAM]) * up[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def chunks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a text: hash of the anchor's k-gram, first window, anchor, number of windows."""
    out = []
    reach = STEP - 2 * LENGTH
    for low in range(0, len(data) - LENGTH + 1, reach):  # windows starting in [low, low + reach)
        part = data[low:low + reach + LENGTH - 1]
        h = _gram_hashes(part)
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        anchor = (least & _LOW).astype(np.int64)  # ties go to the left, by content alone
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.concatenate([first, [len(anchor)]]))
        out.append((h[anchor[first]], first + low, anchor[first] + low, n))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, t) for t in (np.uint64, int, int, int))


def _pack_at(first: np.ndarray, anchor: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (first << 14) | ((anchor - first) << 7) | n


def _unpack_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, (at >> 7) & 127, at & 127


def _chunk_rows(texts: DataFrame) -> DataFrame:
    """(gram, content, doc, row, at, settled) of every chunk of (row, doc, text).

    A chunk whose like stands earlier in the same few documents is ``settled``: it needs no comparison, and is spread by its
    place instead of its gram. So a text that repeats one word for ever doesn't crowd one gram.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest
        for batch in batches:
            for low in range(0, batch.num_rows, 400):
                part = batch.slice(low, 400)
                columns: list[list] = [[], [], [], [], []]
                for row, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    data = text.as_buffer()
                    gram, first, anchor, n = chunks_of(np.frombuffer(data, np.uint8))
                    view = memoryview(data)
                    content = [xxh3_64_intdigest(view[a:b], int(c)) for a, b, c in zip(
                        first.tolist(), (first + n + LENGTH - 1).tolist(), (anchor - first).tolist())]
                    columns[0].append(gram.view(np.int64))
                    columns[1].append(np.array(content, dtype=np.uint64).view(np.int64))
                    columns[2].append(np.full(len(n), doc))
                    columns[3].append(np.full(len(n), row))
                    columns[4].append(_pack_at(first, anchor, n))
                gram, content, doc, row, at = (np.concatenate(c).astype(np.int64) for c in columns)
                order = np.lexsort((at, row, doc, content, gram))
                like = (gram[order[1:]] == gram[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
                settled = np.zeros(len(gram), dtype=bool)
                settled[order[1:][like]] = True
                gram[settled] = mix((row[settled] * 31 + at[settled]).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (gram, content, doc, row, at, settled))],
                                                 names=["gram", "content", "doc", "row", "at", "settled"])

    return texts.select("row", "doc", "text").mapInArrow(
        work, "gram bigint, content bigint, doc bigint, row bigint, at bigint, settled boolean")


def _sorted_out(chunks: DataFrame) -> DataFrame:
    """(row, at, whole): chunks whose like stands earlier (``whole``), and first chunks of a gram that has others too.

    All chunks of a gram come together in order of content and place. One gram has at most one of the many
    chunks of a text that doesn't repeat itself, so no gram holds more than a small share of all chunks;
    rows are only streamed through.
    """
    in_order = chunks.repartition(shuffle_partitions(chunks), "gram").sortWithinPartitions("gram", "content", "doc", "row", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int, int]] = []  # the first chunk of the open gram's first content, until another comes
        last_gram, last_content, many = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column("settled").to_numpy(zero_copy_only=False)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[done]) for c in ("row", "at")]
                                                 + [pa.array(done[done])], names=["row", "at", "whole"])
                if done.all():
                    continue
            gram, content, row, at = (batch.column(c).to_numpy()[~done] for c in ("gram", "content", "row", "at"))
            before_gram = np.concatenate([[last_gram if last_gram is not None else ~gram[0]], gram[:-1]])
            before_content = np.concatenate([[last_content if last_content is not None else 0], content[:-1]])
            new_gram = gram != before_gram
            again = ~new_gram & (content == before_content)
            fresh = ~new_gram & ~again  # another content of the same gram
            number = np.cumsum(new_gram)
            several = np.zeros(number[-1] + 1, dtype=bool)
            several[number[fresh]] = True
            several[0] |= many
            firsts = (new_gram | fresh) & several[number]
            held = pending if several[0] else []
            if several[0]:
                pending = []
            # the last gram may go on: its single first content waits
            if not several[number[-1]] and new_gram.any():
                k = int(np.flatnonzero(new_gram)[-1])
                pending = [(int(row[k]), int(at[k]))]
            many = bool(several[number[-1]])
            last_gram, last_content = gram[-1], content[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[h[0] for h in held], row[again], row[firsts]]).astype(np.int64)),
                 pa.array(np.concatenate([[h[1] for h in held], at[again], at[firsts]]).astype(np.int64)),
                 pa.array(np.repeat([False, True, False], [len(held), again.sum(), firsts.sum()]))], names=["row", "at", "whole"])

    return in_order.mapInArrow(work, "row bigint, at bigint, whole boolean")


def _contexts(texts: DataFrame, open_chunks: DataFrame) -> DataFrame:
    """(lead, bytes, doc, row, at) of unsettled chunks; ``lead`` is the anchor's k-gram."""
    wanted = open_chunks.groupBy("row").agg(F.collect_list("at").alias("ats"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                leads, bodies, docs, rows, places = [], [], [], [], []
                for r in batch.slice(low, 200).to_pylist():
                    ats = np.array(r["ats"], dtype=np.int64)
                    first, shift, n = _unpack_at(ats)
                    for a, s, c in zip(first.tolist(), shift.tolist(), n.tolist()):
                        leads.append(r["text"][a + s:a + s + GRAM])
                        bodies.append(r["text"][a:a + c + LENGTH - 1])
                    docs += [r["doc"]] * len(ats)
                    rows += [r["row"]] * len(ats)
                    places += r["ats"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leads, pa.binary()), pa.array(bodies, pa.binary()), pa.array(docs, pa.int64()),
                     pa.array(rows, pa.int64()), pa.array(places, pa.int64())], names=["lead", "body", "doc", "row", "at"])

    return texts.join(wanted, "row").select("row", "doc", "text", "ats").mapInArrow(
        work, "lead binary, body binary, doc bigint, row bigint, at bigint")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte characters, and the number of the run of equal rows that each ordered row is in.

    Multikey quicksort, all parts of one depth together: a part is sorted by its next character and falls into parts of
    equal ones; only parts of two rows or more go a character deeper.
    """
    order = np.arange(len(words))
    part = np.zeros(len(words), dtype=np.int64)  # part of each place in ``order``
    live = np.ones(len(words), dtype=bool)
    for depth in range(words.shape[1]):
        places = np.flatnonzero(live)
        if not len(places):
            break
        rows = order[places]
        key = words[rows, depth]
        by = np.lexsort((key, part[places]))
        order[places] = rows[by]
        key, group = key[by], part[places][by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        run = np.cumsum(new) - 1
        part[places] = places[np.flatnonzero(new)][run]  # named by the place where it begins
        live[places] = np.bincount(run)[run] > 1
    return order, part


def _repeats(group: list[tuple]) -> Iterator[tuple[int, int]]:
    """(row, start) of windows of the chunks (body, doc, row, at) whose bytes stand earlier among them."""
    counts = np.array([g[3] & 127 for g in group])
    ends = np.cumsum([0, *(len(g[0]) for g in group)])
    data = np.frombuffer(b"".join(g[0] for g in group) + bytes(8), np.uint8)
    begins = np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(group)), counts)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.empty((len(begins), -(-LENGTH // 8)), dtype=np.uint64)
    for d in range(words.shape[1]):  # the last character starts earlier, so that it ends with the window
        at = begins + min(8 * d, LENGTH - 8)
        words[:, d] = np.ascontiguousarray(eight[at]).view(">u8").ravel()
    order, run = multikey_order(words)
    start = (np.array([g[3] for g in group]) >> 14)[owner] + begins - ends[:-1][owner]
    doc, row = np.array([g[1] for g in group])[owner], np.array([g[2] for g in group])[owner]
    by = order[np.lexsort((start[order], row[order], doc[order], run))]
    run = np.sort(run)
    again = np.concatenate([[False], run[1:] == run[:-1]])
    return zip(row[by[again]].tolist(), start[by[again]].tolist())


GROUP_ROWS = 20_000  # chunks sorted at once; an anchor with more is taken apart


def _removed(found) -> pa.RecordBatch:
    rows, begins = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(begins, pa.int64()),
                                       pa.array([b + LENGTH for b in begins], pa.int64())], names=["row", "start", "stop"])


def _edges(contexts: DataFrame) -> DataFrame:
    """(row, start, stop) removed by windows that repeat in unsettled chunks, whole anchors to a task."""
    ranges = contexts.repartitionByRange(shuffle_partitions(contexts), "lead").sortWithinPartitions("lead")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for lead, body, doc, row, at in zip(*(c.to_pylist() for c in batch.columns)):
                if lead != last and len(held) >= GROUP_ROWS:
                    yield _removed(list(_repeats(held)))
                    held = []
                held.append((body, doc, row, at))
                last = lead
        if len(held) > 1:
            yield _removed(list(_repeats(held)))

    return ranges.select("lead", "body", "doc", "row", "at").mapInArrow(work, "row bigint, start bigint, stop bigint")


def _crowded_edges(contexts: DataFrame) -> DataFrame:
    """The same for anchors of any size: every window's suffix is a row, ranged with its place, so that ranges stay even.

    Inside a range equal suffixes are neighbours; the first row of each range is compared with those of the others.
    """
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = [(body[i:i + LENGTH], doc, row, (at >> 14) + i) for body, doc, row, at in zip(
                    *(c.to_pylist() for c in part.columns)) for i in range(at & 127)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SUFFIX)],
                                                 names=["suffix", "doc", "row", "start"])

    order = ["suffix", "doc", "row", "start"]
    rows = write_shared(contexts.select("body", "doc", "row", "at").mapInArrow(
        suffixes, "suffix binary, doc bigint, row bigint, start bigint"), "suffixes")
    ranges = rows.repartitionByRange(shuffle_partitions(contexts), *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            state = []  # 1: repeats its neighbour, 2: head of the range
            for suffix in columns[0]:
                state.append(2 if last is None else int(suffix == last))
                last = suffix
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, pa.int32())], names=[*order, "state"])

    marked = write_shared(ranges.mapInArrow(work, "suffix binary, doc bigint, row bigint, start bigint, state int").where("state > 0"),
                          "suffix_runs")
    # a head repeats if its suffix stands before it in another range: the last row there has it too
    heads = marked.where("state = 2")
    before = rows.join(heads.select("suffix").distinct(), "suffix", "left_semi").groupBy("suffix").agg(
        F.min(F.struct("doc", "row", "start")).alias("first"))
    crossed = heads.join(before, "suffix").where(F.struct("doc", "row", "start") != F.col("first"))
    found = marked.where("state = 1").select("row", "start").unionByName(crossed.select("row", "start"))
    return found.select("row", "start", (F.col("start") + LENGTH).alias("stop"))


_SUFFIX = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Remove each byte covered by a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller doc_id, or
    earlier in the same one; strings are judged on the input.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (the remaining bytes), one row
    for each input row. A null text is empty. Rows with a null id come before all others; rows of one id are
    separate documents, in the order in which they were read. Other columns are ignored. Anchors with more than ``group_rows``
    different chunks are ranged by whole suffixes; the result is the same.
    """
    ship(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    base = write_bucketed(base, "repeat_texts", "row", shuffle_partitions(docs))
    place = F.coalesce("doc_id", F.lit(-2**63))
    keys = write_shared(base.select("row", place.alias("doc"), "doc_id", F.md5("text").alias("md5"),
                                    F.octet_length("text").cast("bigint").alias("n_bytes")), "repeat_keys")
    first = (keys.where(F.col("n_bytes") >= LENGTH).groupBy("md5", "n_bytes")
             .agg(F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = write_shared(keys.join(first, ["md5", "n_bytes"]).where(F.col("row") != F.col("first.row")).select("row"), "copies")
    texts = base.select("row", place.alias("doc"), "text").join(copies, "row", "left_anti")

    hits = write_shared(_sorted_out(_chunk_rows(texts.where(F.octet_length("text") >= LENGTH))), "repeat_hits")
    contexts = write_shared(_contexts(texts, hits.where("not whole")), "repeat_contexts")
    crowded = write_shared(contexts.groupBy("lead").count().where(F.col("count") > group_rows).select("lead"), "crowded_anchors")
    edges = _edges(contexts.join(crowded, "lead", "left_anti"))
    if not crowded.isEmpty():
        edges = edges.unionByName(_crowded_edges(contexts.join(crowded, "lead", "left_semi")))
    begin, n = F.shiftright("at", 14), F.col("at").bitwiseAND(F.lit(127))
    whole = hits.where("whole").select("row", begin.alias("start"), (begin + n + LENGTH - 1).alias("stop"))
    spans = whole.unionByName(edges).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                removed, runs, kept = [], [], []
                for text, spans in zip(part.column(1), part.column(2)):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    if not spans.is_valid:
                        removed.append(0)
                        runs.append(0)
                        kept.append(text.as_py())
                        continue
                    flat = spans.values
                    edge = (np.bincount(flat.field(0).to_numpy(), minlength=len(data) + 1)
                            - np.bincount(flat.field(1).to_numpy(), minlength=len(data) + 1))
                    gone = np.cumsum(edge)[:len(data)] > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept.append(data[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                                  pa.array(kept, pa.binary())], names=["row", "n_removed", "n_spans", "kept"])

    done = texts.select("row", "text").join(spans, "row", "left").select("row", "text", "spans").mapInArrow(
        cut, "row bigint, n_removed bigint, n_spans bigint, kept binary")
    whole_copies = keys.join(copies, "row", "left_semi").select(
        "row", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    names = keys.select("row", "doc_id", "n_bytes")
    return names.join(done.unionByName(whole_copies), "row").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
