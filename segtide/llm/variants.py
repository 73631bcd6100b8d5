"""Spelling variants: words one insertion, deletion or replacement apart, by search schemes on FM-indexes.

One error leaves one half of a word whole. Either half is matched exactly from its end of the word, and the search goes on across the
other half with one error, over intervals of suffix ranks of the vocabulary, words set apart by delimiters.
The index of the words reads a word from its end, that of the reversed words from its beginning.
Words meet by half: each part of the vocabulary that shares halves has indexes of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.llm.periodic import suffix_ranks
from segtide.llm.tables import documents_in, ship, write_shared

RUN = rb"[a-z\xc0-\xff]+"       # of lower-cased Latin-1
PART_ROWS = 20_000              # rows of a part of the vocabulary, about
HALF_WORDS = 50_000             # words under one half in one part; further ones go to further parts
FEW = 32                        # ranks of an interval looked at one by one
DELIMITER, BEGINNING, FIRST_CODE = 0, 1, 2
NEAR = "word string, n_near bigint, best_n bigint, best string"


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2,
                alter: Callable[[int | None, bytes], bytes] | None = None) -> DataFrame:
    """``word, n``: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all whole texts, only A-Z lower-cased, of at least ``min_length`` code
    points, with how often each occurs, where that is ``min_count`` or more.

    ``alter(doc_id, run)`` may change a run (Latin-1 bytes), once per document and distinct run, before its length counts.
    Counts combine in every task before the shuffle. Null and empty texts have no words; a null id is
    given to ``alter`` as None; rows that share an id count each; other columns are ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = re.compile(RUN), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for ids, texts in documents_in(batches, 1_000_000):
            for doc, text in zip(ids, texts):
                for run, n in Counter(letters.findall(text.encode("latin-1", "replace").lower())).items():
                    run = alter(doc, run) if alter else run
                    if len(run) >= min_length:
                        held[run] = held.get(run, 0) + n
                if len(held) > 500_000:
                    yield out()
                    held = {}
        yield out()

    ship(docs)
    counted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class FmIndex:
    """Suffix-rank intervals over sorted distinct words, each between delimiters, extended to the left."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(flat)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = len(flat) + len(words) + 1
        text = np.full(n, DELIMITER, dtype=np.int64)
        is_letter = np.ones(n, dtype=bool)
        is_letter[np.concatenate([[0], np.cumsum(lengths + 1)])] = False
        text[is_letter] = np.searchsorted(self.alphabet, flat) + FIRST_CODE
        # delimiters in the order of the words they precede, so that a word's number is the rank of its delimiter
        rank, _ = suffix_ranks(np.where(is_letter, text + len(words), np.cumsum(~is_letter) - 1))
        before = np.empty(n, dtype=np.int64)
        before[rank[1:]] = text[:-1]
        before[rank[0]] = BEGINNING
        self.before, self.width = before, n + 1
        order = np.argsort(before, kind="stable")
        self.occurrences = before[order] * self.width + order
        self.codes = np.unique(before[before >= FIRST_CODE])
        self.whole = (0, len(words) + 1)  # every delimiter

    def encode(self, letters: np.ndarray) -> np.ndarray:
        """Codes of code points (0: none); those no word has get a code of their own."""
        at = np.searchsorted(self.alphabet, letters).clip(max=max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == letters if len(self.alphabet) else np.zeros(letters.shape, dtype=bool)
        return np.where(known, at + FIRST_CODE, len(self.alphabet) + FIRST_CODE)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with a code put before."""
        return (np.searchsorted(self.occurrences, code * self.width + low), np.searchsorted(self.occurrences, code * self.width + high))

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, letter's code) of all letters before each interval: as many as it has ranks or the alphabet letters."""
        few = np.flatnonzero(high - low <= FEW)
        size = (high - low)[few]
        of = np.repeat(few, size)
        at = np.arange(len(of)) + np.repeat(low[few] - np.cumsum(size) + size, size)
        code = self.before[at]
        pairs = np.unique((of * self.width + code)[code >= FIRST_CODE])
        many = np.flatnonzero(high - low > FEW)
        return (np.concatenate([pairs // self.width, np.repeat(many, len(self.codes))]),
                np.concatenate([pairs % self.width, np.tile(self.codes, len(many))]))


def one_error(index: FmIndex, asked: list[str], whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the asked word, number of the indexed word) for all indexed words that end in the same ``whole`` letters and differ by exactly one
    error before them; each pair once."""
    lengths = np.array([len(w) for w in asked], dtype=np.int64)
    free = lengths - whole
    letters = np.zeros((len(asked), int(lengths.max()) + 1), dtype=np.int64)  # from the end; 0 behind the beginning
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters[np.repeat(np.arange(len(asked)), lengths), np.repeat(lengths, lengths) - 1 - at] = index.encode(
        np.frombuffer("".join(asked).encode("utf-32-le"), "<u4"))
    q = np.arange(len(asked))
    low, high = np.full(len(asked), index.whole[0]), np.full(len(asked), index.whole[1])
    for i in range(whole):
        low, high = index.extend(letters[q, i], low, high)
        q, low, high = (x[high > low] for x in (q, low, high))
    found_q, found = [], []

    def finish(q: np.ndarray, done: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The rest without an error, up to the delimiter."""
        while len(q):
            ended = done == free[q]
            low, high = index.extend(np.where(ended, DELIMITER, letters[q, whole + done]), low, high)
            alive = high > low
            found_q.append(q[ended & alive])
            found.append(low[ended & alive])
            q, done, low, high = (x[alive & ~ended] for x in (q, done, low, high))
            done = done + 1

    for done in range(int(free.max()) + 1):
        q, low, high = (x[free[q] >= done] for x in (q, low, high))
        here, ahead = letters[q, whole + done], letters[q, np.minimum(whole + done + 1, letters.shape[1] - 1)]
        left, last = free[q] > done, free[q] == done + 1
        which, code = index.choices(low, high)
        other = ~left[which] | (code != here[which])  # a letter put in beside its like is put in behind all of them
        which, code = which[other], code[other]
        lows, highs = index.extend(code, low[which], high[which])
        more = left[which]
        gone = left & (last | (ahead != here))        # of like letters the last is taken out
        finish(np.concatenate([q[which], q[which][more], q[gone]]),
               np.concatenate([np.full(len(which), done), np.full(int(more.sum()) + int(gone.sum()), done + 1)]),
               np.concatenate([lows, lows[more], low[gone]]), np.concatenate([highs, highs[more], high[gone]]))
        q, here, low, high = q[left], here[left], low[left], high[left]
        low, high = index.extend(here, low, high)
        q, low, high = (x[high > low] for x in (q, low, high))
    return np.concatenate([*found_q, np.empty(0, np.int64)]), np.concatenate([*found, np.empty(0, np.int64)])


def _near_in_part(part: pa.Table) -> pa.Table:
    """Of one part: per asked word the near words found in it, how many and which is the most frequent."""
    out: list[tuple] = []
    rows: dict[tuple, list] = {}
    for row in zip(*[part.column(c).to_pylist() for c in ("from_end", "half", "block", "word", "n", "indexed", "asks")]):
        rows.setdefault(row[:3], []).append(row[3:])  # blocks of a crowded half may share a part
    for (from_end, half, _), held in rows.items():
        turn = (lambda w: w) if from_end else (lambda w: w[::-1])
        n_of = {turn(w): n for w, n, indexed, _ in held if indexed}
        asked = [turn(w) for w, _, _, asks in held if asks]
        if not n_of or not asked:
            continue
        words = sorted(n_of)
        best: dict[str, tuple] = {}
        found: Counter = Counter()
        for i, k in zip(*(x.tolist() for x in one_error(FmIndex(words), asked, half))):
            mine, near = asked[i], words[k]
            if from_end and near.startswith(mine[:len(mine) - half]):
                continue  # the search from the beginning finds this one
            found[mine] += 1
            candidate = (-n_of[near], turn(near))
            best[mine] = min(best.get(mine, candidate), candidate)
        out += [(turn(w), n, -best[w][0], best[w][1]) for w, n in found.items()]
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def _half_rows(words: DataFrame) -> DataFrame:
    """Each word under the halves at which words of its length, one less or one more are cut; ``asks`` where it is its own."""
    m = F.length("word")

    def cut(length: Column, from_end: bool) -> Column:
        return F.call_function("div", length + int(from_end), F.lit(2)).cast("int")

    def halves(from_end: bool) -> Column:
        sizes = F.array_distinct(F.array(*[F.greatest(cut(m + d, from_end), F.lit(0)) for d in (-1, 0, 1)]))
        return F.transform(sizes, lambda k: F.struct(
            F.lit(from_end).alias("from_end"), k.alias("half"), (k == cut(m, from_end)).alias("asks"),
            F.xxhash64(F.lit(from_end), k, F.substring("word", (m - k + 1) if from_end else F.lit(1), k)).alias("key")))

    return words.select("word", "n", F.explode(F.concat(halves(False), halves(True))).alias("_h")).select("word", "n", "_h.*")


def near_words(words: DataFrame, part_rows: int = PART_ROWS, half_words: int = HALF_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` for the words (``word, n``, one row each, written) with near words.

    Words meet by the half they share. A half with more than ``half_words`` words is cut into blocks by a hash of the word, and words
    ask in all of its blocks; what a word finds in its parts is put together per word, one row a part.
    """
    rows = _half_rows(words)
    crowded = write_shared(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > half_words)
                           .select("key", F.ceil(F.col("_n") / half_words).cast("int").alias("_blocks")), "crowded_halves")
    parts = -(-4 * words.count() // part_rows) or 1
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    dealt = (rows.join(crowded, "key", "left").withColumn("_own", own)
             .withColumn("_block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("_own"))))
             .select(F.pmod(F.xxhash64("key", "_block"), F.lit(parts)).alias("part"), "from_end", "half", F.col("_block").alias("block"),
                     "word", "n", (F.col("_block") == F.col("_own")).alias("indexed"), "asks"))
    ship(words)
    found = dealt.groupBy("part").applyInArrow(_near_in_part, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` for words with a form: forms followed to the last, at most ``steps`` of them, twice as far each round."""
    reached = write_shared(forms.select("word", F.col("form").alias("root")), "roots")
    far = 1
    while far < steps:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        reached = write_shared(reached.join(onward, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots")
        far *= 2
    return reached


def spelling_variants(counts: DataFrame, ratio: int = 10, part_rows: int = PART_ROWS, half_words: int = HALF_WORDS) -> DataFrame:
    """Words (``word, n``) with the form each is a variant of.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's ``form`` is its near word of
    largest n (ties: smallest in code-point order), where that n is ``ratio`` (2 or more) times its own; ``root`` is the last of the forms that
    follow one another, the word itself without a form. Returns ``word, form, root, n, n_near`` (0 where none is near) and ``form_n``, one row for each
    distinct word: counts of repeated rows are added up, rows with a null word or no positive count are left out, other columns
    ignored, an empty table gives an empty one. Words may be of any length and script.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants")
    summed = counts.where("word is not null and n > 0").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = write_shared(summed, "vocabulary")
    near = near_words(words, part_rows, half_words)
    formed = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    linked = write_shared(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")), "variants")
    steps, most = 0, words.agg(F.max("n")).first()[0] or 1
    while most >= ratio:
        steps, most = steps + 1, most // ratio
    return (linked.join(roots(linked.where("form is not null"), steps), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def forget_letters(doc_id: int | None, run: bytes) -> bytes:
    """The run without one letter where the checksum of id and run is a multiple of 31; a null id never."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:".encode() + (run if run.isascii() else run.decode("latin-1").encode()))
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
