"""Benchmark decontamination by common words, with a latent semantic space for how near a match is.

Documents are cut into passages of words. Every stretch of passages that has enough of an item's words to match it is checked
by the longest common subsequence of words, and paraphrases by whether the item's answer is there too; no match is lost
before that check. A randomised SVD of the passages' TF-IDF matrix (one distributed pass) gives a latent space, in which matches
are compared with their items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.tables import pack, ragged_take, release_memory, ship, starts, unpack, write_shared

MAX_ITEMS = 20_000  # benchmark items that may be handed to every task
_STRIP = b".,;:!?\"'()[]{}|*#%&$<>-_=+/\\`~"


def words_of(text: str) -> list[bytes]:
    """Words in lower case between ASCII white space, without ASCII punctuation at their ends."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().encode().split()) if w]


@dataclass
class Space:
    """The latent space and the benchmark in it; bounded by the benchmark's words."""

    item_ids: list[int]
    items: list[np.ndarray]  # numbers of each item's words
    answers: list[int]  # where the answer begins in it
    telling: list[np.ndarray]  # each item's words without those that are everywhere
    frequency: np.ndarray  # passages of the corpus that each word is in
    stride: int  # words of a passage
    whole: np.ndarray  # items that are too short to be told by a share of their words
    weights: np.ndarray  # words x rank: inverse document frequency times the latent direction
    latent: np.ndarray  # items x rank, of length 1


def _answer_at(text: str, words: list[bytes]) -> int:
    """First word of the last sentence, or of the last quarter where that is shorter than 3 words or most of the item."""
    sentences = [s for s in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if words_of(s)]
    last = len(words_of(sentences[-1])) if sentences else 0
    return len(words) - (last if 3 <= last <= len(words) // 2 else max(len(words) // 4, 1))


def encode_words(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, numbers): every word of every whole text as its number in the benchmark's vocabulary, 0 for others."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                coded = []
                for text in part.column(1).to_pylist():
                    words = words_of(text or "")
                    coded.append(pack(np.fromiter((get(w, 0) for w in words), np.uint32, len(words))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())], names=["doc_id", "numbers"])
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, numbers binary")


def _passages(batch: pa.RecordBatch, stride: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Informative words of groups of documents: their numbers, the passage of each, and how many passages there are."""
    numbers, places, n, held = [], [], 0, 0
    for coded in batch.column("numbers").to_pylist():
        words = unpack(coded)
        at = np.flatnonzero(known[words])
        numbers.append(words[at])
        places.append(n + at // stride)
        n += -(-len(words) // stride)
        held += len(at)
        if held > 100_000:
            yield np.concatenate(numbers), np.concatenate(places), n
            numbers, places, n, held = [], [], 0, 0
    if numbers:
        yield np.concatenate(numbers), np.concatenate(places), n


def _first_of(group: np.ndarray) -> np.ndarray:
    """Where each group begins; ``group`` ascends."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)


def _by_group(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by group; ``group`` ascends."""
    out = np.zeros((groups, values.shape[1]), dtype=values.dtype)
    if len(group):
        first = _first_of(group)
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _sums_of_rows(table: np.ndarray, picks: np.ndarray, first: np.ndarray, rounds: int = 32) -> np.ndarray:
    """Sums of the rows ``table[picks]`` by group, a group going from one place of ``first`` to the next.

    The n-th rows of all groups are added at once, whole rows at a time; groups longer than ``rounds`` are added up by themselves.
    """
    lengths = np.diff(first, append=len(picks))
    out = np.empty((len(first), table.shape[1]), dtype=table.dtype)
    for i in np.flatnonzero(lengths > rounds):
        out[i] = table[picks[first[i]:first[i] + lengths[i]]].sum(axis=0)
    short = np.flatnonzero(lengths <= rounds)
    short = short[np.argsort(-lengths[short], kind="stable")]
    if len(short):
        begin, ends = first[short], np.searchsorted(-lengths[short], -np.arange(lengths[short[0]]))
        sums = table[picks[begin]]
        for nth in range(1, len(ends)):
            sums[:ends[nth]] += table[picks[begin[:ends[nth]] + nth]]
        out[short] = sums
    return out


def _add_gram(total: np.ndarray, omega: np.ndarray, numbers: np.ndarray, places: np.ndarray, piece: int = 10_000) -> None:
    """Adds ``B'B`` times ``omega`` to ``total``, where B says how often a passage has a word; ``places`` ascends.

    Rows as long as those of ``omega`` are held for whole passages of about ``piece`` words at a time.
    """
    bounds = np.append(_first_of(places), len(places))
    passage = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cuts = np.unique(np.searchsorted(bounds, [*range(0, len(places), piece), len(places)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = slice(bounds[a], bounds[b])
        projected = _sums_of_rows(omega, numbers[part], bounds[a:b] - bounds[a])
        order = np.argsort(numbers[part], kind="stable")
        mine = numbers[part][order]
        first = _first_of(mine)
        total[mine[first]] += _sums_of_rows(projected, passage[part][order] - a, first)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; sorts the array in place."""
    values.sort()
    return values[_first_of(values)]


def document_frequencies(coded: DataFrame, size: int, stride: int) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each word of the vocabulary occurs, and how many passages there are."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(size, dtype=np.int64), 0
        every = np.ones(size, dtype=bool)
        every[0] = False
        for batch in batches:
            for numbers, places, n in _passages(batch, stride, every):
                pairs = _distinct(places * size + numbers)
                total += np.bincount(pairs % size, minlength=size)
                passages += n
        total[0] = passages
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["word", "n"])

    counts = coded.select("numbers").mapInArrow(work, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    passages, out[0] = int(out[0]), 0
    return out, passages


def gram_sketch(coded: DataFrame, idf: np.ndarray, stride: int, columns: int, seed: int = 11) -> tuple[np.ndarray, float]:
    """``A'A`` times a random matrix, and the sum of squared weights of all words, where A holds the TF-IDF of all passages.

    Each task adds up its own passages; the sums meet by row blocks in two steps, so no task holds more than a
    share of them. Only the result, of the vocabulary's size, comes back.
    """
    size, rows = len(idf), 256
    shared = coded.sparkSession.sparkContext.broadcast(idf)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        omega = np.random.default_rng(seed).standard_normal((size, columns), dtype=np.float32)
        omega *= weight[:, None].astype(np.float32)  # a word counts as often as it stands in the passage
        total, energy = np.zeros((size, columns)), 0.0
        for batch in batches:
            for numbers, places, _ in _passages(batch, stride, weight > 0):
                energy += float((weight[numbers] ** 2).sum())
                _add_gram(total, omega, numbers, places)
        total *= weight[:, None]
        task = TaskContext.get().partitionId()
        blocks = range(0, size, rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * (len(blocks) + 1), pa.int32()), pa.array([-1, *range(len(blocks))], pa.int32()),
             pa.array([np.float64(energy).tobytes(), *(total[b:b + rows].tobytes() for b in blocks)], pa.binary())],
            names=["task", "block", "sums"])
        del omega, total
        release_memory()

    def add(rows_of: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s) for s in rows_of.column("sums").to_pylist())
        return pa.table([rows_of.column("task").slice(0, 1), rows_of.column("block").slice(0, 1), pa.array([total.tobytes()])],
                        names=["task", "block", "sums"])

    schema = "task int, block int, sums binary"
    sums = coded.select("numbers").mapInArrow(work, schema)
    sums = sums.groupBy("block", F.pmod("task", F.lit(32)).alias("share")).applyInArrow(add, schema)
    sums = sums.groupBy("block").applyInArrow(add, schema).toArrow().sort_by("block").column("sums").to_pylist()
    return np.concatenate([np.frombuffer(s).reshape(-1, columns) for s in sums[1:]]), float(np.frombuffer(sums[0])[0])


def telling_words(items: list[np.ndarray], frequency: np.ndarray, limit: float) -> list[np.ndarray]:
    """Of each item the words in at most ``limit`` passages, and always the rarest half: copies of an item make its own words
    frequent, and it must not vanish by that."""
    out = []
    for words in items:
        distinct, place, times = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(frequency[distinct], kind="stable")
        rare = np.empty(len(distinct), dtype=bool)
        rare[order] = np.cumsum(times[order]) - times[order] < len(words) / 2
        out.append(words[((frequency[distinct] <= limit) | rare)[place]])
    return out


def latent_space(coded: DataFrame, item_ids: list[int], items: list[np.ndarray], answers: list[int], size: int,
                 rank: int = 256, max_share: float = 0.05, min_words: int = 0) -> Space:
    """Randomised SVD (one-pass Nystrom form) of the TF-IDF of all passages and the benchmark's items, the latter weighted to the same
    total energy. Words that tell nothing in any item (see ``telling_words``; in more than ``max_share`` of the passages)
    have no weight."""
    stride = int(max(24, np.percentile([len(i) for i in items], 95)))
    frequency, passages = document_frequencies(coded, size, stride)
    idf = np.log((1 + passages) / (1 + frequency)) + 1
    telling = telling_words(items, frequency, max(max_share * passages, 5))
    known = np.zeros(size, dtype=bool)
    known[np.concatenate(telling)] = True
    idf[~known] = 0
    columns = min(size, rank + 16)
    gram, energy = gram_sketch(coded, idf, stride, columns)
    omega = np.random.default_rng(11).standard_normal((size, columns), dtype=np.float32).astype(np.float64)
    vectors = []
    for words in items:
        word, times = np.unique(words, return_counts=True)
        vectors.append((word, times * idf[word]))
    own_energy = sum(float((v ** 2).sum()) for _, v in vectors)
    share = (energy / own_energy) if own_energy and energy else 1.0
    for word, value in vectors:
        gram[word] += share * value[:, None] * (value @ omega[word])[None, :]
    shift = 1e-9 * max(np.linalg.norm(gram), 1e-12)
    gram = gram + shift * omega
    core = omega.T @ gram
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    basis, _, _ = np.linalg.svd(gram @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)
    basis = basis[:, :rank]
    weights = (idf[:, None] * basis).astype(np.float32)
    latent = np.stack([(v[:, None] * basis[w]).sum(0) for w, v in vectors])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Space(item_ids, items, answers, telling, frequency, stride, np.array([len(i) < min_words for i in items]), weights, latent.astype(np.float32))


def common_subsequence(pattern_masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, the pattern's places as bits of one number."""
    full = (1 << length) - 1
    row = full
    for w in words:
        mask = pattern_masks.get(w)
        if mask is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for place, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | (1 << place)
    return out


class CommonWords:
    """A bound on how many of an item's telling words can be in a stretch of passages, without loss.

    ``share`` of them have to be in the stretch; a word counts in every passage that has it, as often as the item has it.
    """

    def __init__(self, s: Space, share: float, passages: np.ndarray, cells: int = 250_000):
        size, n_items = s.weights.shape[0], len(s.items)
        self.n_items, self.longest = n_items, int(passages.max())
        self.of_length = [(int(p), np.flatnonzero(passages == p)) for p in np.unique(passages)]
        self.rows = max(cells // n_items, 2 * self.longest)
        self.need = np.full(n_items, np.inf)
        words, owners, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.flatnonzero(~s.whole):
            distinct, n = np.unique(s.telling[k], return_counts=True)
            self.need[k] = max(np.ceil(share * len(s.telling[k]) - 1e-9), 1)
            words.append(distinct)
            owners.append(np.full(len(distinct), k))
            times.append(n)
        words = np.concatenate(words)
        order = np.argsort(words, kind="stable")
        self.owners, self.times = np.concatenate(owners)[order], np.concatenate(times)[order]
        self.offsets = starts(np.bincount(words, minlength=size))
        self.known = self.offsets[1:] > self.offsets[:-1]

    def near(self, words: np.ndarray, stride: int) -> Iterator[tuple[int, int]]:
        """(first passage, item) of every stretch of a document that may match; a stretch over the end is within the last whole one."""
        return ((first, k) for _, first, k in self.near_any([words], stride))

    def near_any(self, documents: list[np.ndarray], stride: int) -> Iterator[tuple[int, int, int]]:
        """(place of the document, first passage, item) of every such stretch of several documents."""
        size = len(self.known)
        begin = starts(np.array([-(-len(words) // stride) for words in documents], dtype=np.int64))
        numbers, places = [], []
        for words, passage in zip(documents, begin.tolist()):
            at = np.flatnonzero(self.known[words])
            numbers.append(words[at])
            places.append(passage + at // stride)
        place, word = np.divmod(_distinct(np.concatenate(places) * size + np.concatenate(numbers)), size)
        document = np.repeat(np.arange(len(documents)), np.diff(begin))  # of each passage
        ends = begin[1:][document]
        step = self.rows - self.longest + 1
        for low in range(0, len(document), step):
            rows = min(self.rows, len(document) - low)
            a, b = np.searchsorted(place, (low, low + rows))
            owner, lengths = ragged_take(self.owners, self.offsets, word[a:b])
            times, _ = ragged_take(self.times, self.offsets, word[a:b])
            cell = np.repeat(place[a:b] - low, lengths) * self.n_items + owner
            total = np.zeros((rows + 1, self.n_items))
            np.cumsum(np.bincount(cell, times, rows * self.n_items).reshape(rows, -1), axis=0, out=total[1:])
            every = np.arange(low, min(low + step, len(document)))
            for passages, items in self.of_length:
                firsts = every[(every + passages <= ends[every]) | (every == begin[document[every]])]
                stop = np.minimum(firsts + passages, ends[firsts])
                for i, k in zip(*np.nonzero((total[stop - low] - total[firsts - low])[:, items] >= self.need[items])):
                    first = int(firsts[i])
                    yield int(document[first]), first - int(begin[document[first]]), int(items[k])


class WholeItems:
    """Short items, found where all their words stand in a row; looked for at their rarest word."""

    def __init__(self, s: Space):
        self.at: dict[int, dict[tuple[int, int], dict[bytes, list[int]]]] = {}
        for k in np.flatnonzero(s.whole):
            item = s.items[k].astype("<u4")
            before = int(s.frequency[item].argmin())
            shapes = self.at.setdefault(int(item[before]), {})
            shapes.setdefault((before, len(item)), {}).setdefault(item.tobytes(), []).append(int(k))
        self.known = np.zeros(s.weights.shape[0], dtype=bool)
        self.known[list(self.at)] = True

    def near(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, item) of every place of an item in a document."""
        if self.at:
            for place in np.flatnonzero(self.known[words]).tolist():
                for (before, length), items in self.at[int(words[place])].items():
                    if place >= before:
                        for k in items.get(words[place - before:place - before + length].tobytes(), ()):
                            yield place - before, k


MATCHES = "doc_id bigint, item_id bigint, cosine double, common_share double, answer_share double, word_at bigint"


def search(coded: DataFrame, space: Space, sure: float = 0.8, likely: float = 0.55, min_answer: float = 0.75) -> DataFrame:
    """Stretches of all documents whose words confirm an item.

    A stretch is four passages, or half as much again as a longer item, starting at every passage. It matches if the longest common subsequence with the item holds ``sure``
    of its words, or ``likely`` of them and ``min_answer`` of its answer; ``likely`` of the words that tell something
    must be in order there in either case. ``cosine`` and ``word_at`` are those of its window (the item's length in passages, and
    one) nearest to the item in the latent space. Items in ``whole`` match where all their words stand in a row.
    """
    shared = coded.sparkSession.sparkContext.broadcast(space)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        masks = [_masks(i) for i in s.items]
        ends = [_masks(i[a:]) for i, a in zip(s.items, s.answers)]
        tell_masks = [_masks(i) for i in s.telling]
        lengths = np.array([len(i) for i in s.items])
        reach = np.maximum(-(-3 * lengths // (2 * s.stride)) + 1, 4)  # passages of a stretch
        wide = -(-lengths // s.stride) + 1  # and of a window
        common_words, whole_items = CommonWords(s, likely, reach), WholeItems(s)
        known = np.abs(s.weights).max(axis=1) > 0

        def confirm(words: np.ndarray, first: int, k: int) -> tuple[float, float]:
            part = words[first * s.stride:(first + reach[k]) * s.stride]
            part = part[part > 0].tolist()
            n, a, told = len(s.items[k]), s.answers[k], len(s.telling[k])
            if told and common_subsequence(tell_masks[k], told, part) < likely * told:
                return 0.0, 0.0
            return (common_subsequence(masks[k], n, part) / n,
                    common_subsequence(ends[k], n - a, part) / (n - a) if n > a else 1.0)

        def nearest(words: np.ndarray, first: int, passages: int, k: int) -> tuple[int, float]:
            """Of the windows of the item that begin in some passages, the one nearest to it."""
            words = words[first * s.stride:(first + passages) * s.stride]
            at = np.flatnonzero(known[words])
            z = _by_group(s.weights[words[at]], at // s.stride, -(-len(words) // s.stride))
            window = np.stack([z[f:f + wide[k]].sum(0) for f in range(len(z))])
            near = window @ s.latent[k] / np.maximum(np.linalg.norm(window, axis=1), 1e-12)
            return int(near.argmax()), float(near.max())

        def in_documents(ids: list, documents: list[np.ndarray], out: list) -> None:
            best: list[dict[int, tuple]] = [{} for _ in documents]
            for d, first, k in common_words.near_any(documents, s.stride):
                common, answer = confirm(documents[d], first, k)
                if common >= sure or common >= likely and answer >= min_answer:
                    at, near = nearest(documents[d], first, reach[k] - 1, k)
                    found = (common, near, answer, (first + at) * s.stride)
                    best[d][k] = max(best[d].get(k, found), found)
            for doc, words, found in zip(ids, documents, best):
                for at, k in whole_items.near(words):
                    if k not in found:
                        found[k] = (1.0, nearest(words, at // s.stride, wide[k], k)[1], 1.0, at)
                out += [(doc, s.item_ids[i], c, m, a, at) for i, (m, c, a, at) in sorted(found.items())]

        for batch in batches:
            out: list[tuple] = []
            ids, documents, held = [], [], 0
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("numbers")):
                ids.append(doc)
                documents.append(unpack(packed.as_py()))
                held += len(documents[-1])
                if held > 100_000 or len(ids) == 2000:
                    in_documents(ids, documents, out)
                    ids, documents, held = [], [], 0
            if ids:
                in_documents(ids, documents, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
        release_memory()

    return coded.mapInArrow(work, MATCHES)


_NAMES = [c.split(" ")[0] for c in MATCHES.split(", ")]
_TYPES = [pa.int64() if c.endswith("bigint") else pa.float64() for c in MATCHES.split(", ")]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, rank: int = 256, **search_options) -> DataFrame:
    """Benchmark items found in documents: ``doc_id, item_id, cosine, common_share, answer_share, word_at``, one row for
    each pair.

    ``benchmark`` has ``item_id`` and ``text`` and at most ``MAX_ITEMS`` rows (more end the job). Items with fewer than
    ``min_words`` words match where all their words stand in a row; those without a word, or with a null text or id, are not searched; documents with a null id or text match nothing; repeated
    rows give one row. Other columns are ignored. No items or no documents give no rows.
    """
    ship(docs)
    rows = (benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
            .where("item_id is not null and text is not null").limit(MAX_ITEMS + 1).collect())
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"a benchmark may have {MAX_ITEMS} items at most: search it in parts")
    number: dict[bytes, int] = {}
    item_ids, items, answers = [], [], []
    for row in sorted(rows):
        words = words_of(row["text"])
        if words:
            item_ids.append(row["item_id"])
            items.append(np.array([number.setdefault(w, len(number) + 1) for w in words]))
            answers.append(_answer_at(row["text"], words))
    if not items:
        return docs.sparkSession.createDataFrame([], MATCHES)
    coded = write_shared(encode_words(docs.where("doc_id is not null"), number), "benchmark_words")
    space = latent_space(coded, item_ids, items, answers, len(number) + 1, rank, min_words=min_words)
    release_memory()  # a driver goes on to other work
    found = search(coded, space, **search_options)
    top = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common_share", "cosine", "answer_share", "word_at")).alias("m"))
    return top.select("doc_id", "item_id", "m.cosine", "m.common_share", "m.answer_share", "m.word_at")
