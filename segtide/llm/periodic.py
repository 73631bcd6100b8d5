"""Periodic runs of words, as maximal pairs of an LCP-interval tree.

A run of smallest period q from word s, L words long, is the maximal pair of s and s + q: equal for L - q words, with different words
before and behind. With L >= exponent * q such a pair matches (exponent - 1) times as many words as it is wide, and
every maximal pair that does so is a run (or a multiple of its period), so nothing is extended.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.tables import documents_in, ship

GROUP_CHARS = 4_000_000  # text worked on together; a longer document is a group of its own
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
# any odd 64-bit numbers: hashes only choose what is looked at, and equal stretches always have equal ones
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def _may_pair(ids: np.ndarray, doc_of: np.ndarray, grams: int, times: int) -> np.ndarray:
    """Places that can belong to a pair of fewer than 1 / ``times`` of its matching words apart, at least ``grams`` words matching.

    Such a pair matches h to 2h words for some h = grams * 2^k; then a place's h words come again within 2h / times words. A superset:
    stretches are told apart by hashes.
    """
    n = len(ids) - grams + 1
    useful = np.zeros(len(ids), dtype=bool)
    if n <= 0:
        return useful
    hashes = _stir(doc_of[:n].astype(np.uint64) * ODD[2] + ODD[0])
    for i in range(grams):
        hashes = _stir(hashes * ODD[0] + ids[i:i + n].astype(np.uint64))
    place, h = np.arange(n), grams
    where = np.full(len(ids) + 1, -1, dtype=np.int64)
    while len(place):
        order = np.argsort(hashes, kind="stable")
        at, key = place[order], hashes[order]
        same = key[1:] == key[:-1]
        near = same & (at[1:] - at[:-1] < -(-2 * h // times))
        useful[at[1:][near]] = True
        useful[at[:-1][near]] = True
        again = np.zeros(len(at), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        kept = np.sort(order[again])
        place, hashes = place[kept], hashes[kept]
        where[place] = np.arange(len(place))
        beyond = np.full(len(place), -1, dtype=np.int64)
        inside = place + h < len(ids)
        beyond[inside] = where[place[inside] + h]
        where[place] = -1
        both = beyond >= 0
        hashes = _stir(hashes[both] * ODD[0] + hashes[beyond[both]])
        place, h = place[both], 2 * h
    return useful


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Place of every suffix among the sorted suffixes, by prefix doubling over those not yet told apart; and for each
    length h the (places, ranks) whose first h words occur more than once."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(heads, np.diff(heads, append=n))
    size = np.bincount(rank, minlength=n)
    open_, h, levels = np.flatnonzero(size[rank] > 1), 1, []
    while len(open_):
        levels.append((h, open_, rank[open_].copy()))
        ahead = open_ + h  # the last id occurs once, so no suffix that is still open reaches the end
        key = rank[open_] * n + rank[ahead]
        order = np.argsort(key, kind="stable")
        key, old = key[order], rank[open_][order]
        new_group = np.diff(old, prepend=-1) != 0
        new_sub = np.diff(key, prepend=-1) != 0
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new_group, at, 0))
        head = np.maximum.accumulate(np.where(new_sub, at, 0))
        rank[open_[order]] = old + head - first
        alone = new_sub & np.append(new_sub[1:], True)
        open_, h = np.sort(open_[order[~alone]]), 2 * h
    return rank, levels


def _common(x: np.ndarray, y: np.ndarray, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many words the suffixes at x and y have in common, pair by pair."""
    out = np.zeros(len(x), dtype=np.int64)
    for h, places, ranks in reversed(levels):
        i = np.searchsorted(places, x + out).clip(max=len(places) - 1)
        j = np.searchsorted(places, y + out).clip(max=len(places) - 1)
        out[(places[i] == x + out) & (places[j] == y + out) & (ranks[i] == ranks[j])] += h
    return out


class _Node:
    """Places below an LCP interval, in order, and by the word on their left."""

    __slots__ = ("at", "by_left")

    def __init__(self, place: int, left: int):
        self.at, self.by_left = [place], {left: [place]}

    def take(self, other: _Node) -> None:
        for mine, theirs in [(self.at, other.at)] + [(self.by_left.setdefault(c, []), p) for c, p in other.by_left.items()]:
            if len(theirs) * 8 > len(mine):
                mine += theirs
                mine.sort()
            else:
                for place in theirs:
                    insort(mine, place)


def maximal_pairs(places: np.ndarray, common: np.ndarray, ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(x, y, words in common) of maximal pairs x < y of the sorted suffixes ``places`` with at least ``least`` words
    in common, and ``times`` as many as y - x. ``common[i]`` is between places i and i + 1.

    Intervals close from the deepest. Of two children the smaller one's places look into the larger one's lists of other left words.
    Matches as near as that stand a multiple of one period apart. So behind a place all have the same left word, and before it all
    but the first have its own: one look each way finds the list with partners, and all in reach there are partners.
    """
    left = ids[places - 1].tolist()
    left_of = dict(zip(places.tolist(), left))
    stack: list[tuple[int, _Node]] = []  # (words in common with the node below, node)

    def partners(node: _Node, x: int, reach: int):
        own, at = left_of[x], node.at
        i = bisect_right(at, x)
        if i < len(at) and at[i] - x <= reach and left_of[at[i]] != own:
            others = node.by_left[left_of[at[i]]]
            for y in others[bisect_right(others, x):bisect_right(others, x + reach)]:
                yield x, y
        i = bisect_left(at, x - reach)
        if i < len(at) and at[i] < x and left_of[at[i]] != own:
            yield at[i], x

    depths = [0, *common.tolist()]
    for place, own, depth in zip([*places.tolist(), -1], [*left, -1], [*depths, 0]):
        while len(stack) > 1 and stack[-1][0] > depth:
            inner, top = stack.pop()
            below_depth, below = stack.pop()
            small, big = (top, below) if len(top.at) < len(below.at) else (below, top)
            for x in small.at:
                for a, b in partners(big, x, inner // times):
                    yield a, b, inner
            big.take(small)
            stack.append((below_depth, big))
        if depth < least:
            stack.clear()
        if place >= 0:
            stack.append((depth, _Node(place, own)))


def find_runs(words: list[list], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) by start, then period: stretches that no neighbour extends, at least
    ``least`` words and ``exponent`` (3 or more) times their smallest period long."""
    times = exponent - 1
    matching = least - max(least // exponent, 1)  # fewest words a pair has in common
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if matching < 1 or times < 2:
        raise ValueError("runs need exponent 3 and two words at least")

    def laid(chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as numbers, a number used once before, between and behind the documents; where they begin; whose they are."""
        seen: defaultdict = defaultdict(count(1).__next__)
        lengths = np.array([len(words[d]) for d in chosen], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
        ids = np.zeros(begins[-1], dtype=np.int64)
        for d, b in zip(chosen, begins):
            ids[b:b + len(words[d])] = np.fromiter(map(seen.__getitem__, words[d]), np.int64, len(words[d]))
        ids[begins - 1] = -1 - np.arange(len(begins))
        return ids, begins, np.repeat(np.arange(len(begins)), np.append(lengths + 1, 1))

    long_enough = [d for d, w in enumerate(words) if len(w) >= least]
    if not long_enough:
        return out
    ids, _, doc_of = laid(long_enough)
    hits = np.unique(doc_of[_may_pair(ids, doc_of, matching, times)])
    chosen = [long_enough[i] for i in hits]
    if not chosen:
        return out
    ids, begins, doc_of = laid(chosen)
    places = np.flatnonzero(_may_pair(ids, doc_of, matching, times) & (ids > 0))
    rank, levels = suffix_ranks(ids)
    places = places[np.argsort(rank[places])]
    common = _common(places[:-1], places[1:], levels)
    found: dict[tuple[int, int], int] = {}
    for x, y, equal in maximal_pairs(places, common, ids, matching, times):
        if equal >= times * (y - x) and equal + y - x >= least:
            stretch = (x, equal + y - x)
            found[stretch] = min(found.get(stretch, y - x), y - x)
    for (x, length), period in sorted(found.items(), key=lambda run: (run[0][0], run[1])):
        k = int(doc_of[x])
        out[chosen[k]].append((x - int(begins[k]), length, period))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Runs of every whole text (``doc_id, text``) and the text with each run cut to its first period.

    Returns ``doc_id, n_words, runs`` (by start, then period; words numbered from 0), ``collapsed`` (kept words joined by one space), one
    row for each input row, in place: nothing is shuffled. Words stand between ASCII white space. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``; a null id stays null, repeated rows and ids give repeated rows, other
    columns are ignored, an empty table gives an empty one. A document is never cut; one longer than ``group_chars`` is worked on alone.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in documents_in(batches, group_chars):
            words = [text.encode().split() for text in texts]
            runs = find_runs(words, exponent, least)
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs)]
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(listed, RUNS), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    ship(docs)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and hashes of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(*[x for name, mark in (("start", ","), ("length", ","), ("period", "\n"))
                                                     for x in (r[name].cast("string"), F.lit(mark))]))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.call_function("div", F.col("_best.length") * 1000, -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
