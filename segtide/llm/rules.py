"""Quality rules: text statistics, and an ordered list of threshold rules learned from labelled documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.llm.tables import documents_in, ship, write_shared

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _repeated(numbers: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(numbers) < 4:
        return 0
    pair = numbers[:-1] * n_distinct + numbers[1:]
    if n_distinct > 2_000_000:  # three numbers no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * n_distinct + numbers[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(window) + 2, dtype=bool)
    for side in (order[1:][same], order[:-1][same]):
        again[side] = again[side + 1] = again[side + 2] = True
    return int(again.sum())


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def text_stats(docs: DataFrame) -> DataFrame:
    """Statistics of every whole text: words between ASCII white space, their characters, symbol characters,
    lines equal to an earlier line, words in repeated windows of three.

    One row for each input row; a null text has no words, a null id stays null, other columns are ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in documents_in(batches, 16_000_000):
            seen: defaultdict = defaultdict(count().__next__)
            number = seen.__getitem__
            rows = []
            for text in texts:
                words = text.encode().split()
                numbers = np.fromiter(map(number, words), np.int64, len(words))
                rows.append((len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                             _repeated_lines(text), numbers))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)),
                 pa.array([_repeated(r[4], len(seen)) for r in rows], pa.int64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    ship(docs)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, STATS)


#: What the rules may test, as expressions of the statistics.
TESTS = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    bound: float

    def of(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return stats[self.name] >= self.bound if self.at_least else stats[self.name] < self.bound

    def column(self) -> Column:
        value = F.expr(TESTS[self.name])
        return value >= F.lit(self.bound) if self.at_least else value < F.lit(self.bound)


def _covers(rule: list[Condition], stats: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(stats.values())))
    return reduce(np.logical_and, [c.of(stats) for c in rule], np.ones(size, dtype=bool))


def _grow(stats: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition of highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while bad[inside].any() and not bad[inside].all() and len(rule) < 4:
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, values in stats.items():
            order = np.argsort(values[inside], kind="stable")
            v, b = values[inside][order], bad[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows below each possible bound
            if not len(cut):
                continue
            below_p = np.cumsum(b)[cut - 1]
            below_n = cut - below_p
            for at_least, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                gain = cp * (np.log2(np.maximum(cp, 1e-9) / np.maximum(cp + cn, 1e-9)) - np.log2(p / (p + n)))
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, at_least, float((v[cut[k] - 1] + v[cut[k]]) / 2)), gain[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.of(stats)
    return rule


def _prune(rule: list[Condition], stats: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Drop the last conditions while the rule does no worse on rows it wasn't grown on."""
    def worth(r: list[Condition]) -> float:
        inside = _covers(r, stats)
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn_rules(labelled: DataFrame, max_rows: int = 20_000, min_precision: float = 0.9, min_rows: int = 5,
                max_rules: int = 12) -> list[list[Condition]]:
    """An ordered list of rules for bad documents, by sequential covering.

    ``labelled`` has the statistics and a boolean ``bad``. It is fitted on at most ``max_rows`` rows, those
    with the smallest hash of their id; two thirds grow a rule, one third prunes it. A rule that covers fewer than
    ``min_rows`` bad rows or is right in less than ``min_precision`` of its rows (on either part) ends the search.
    No labels or labels of one kind give no rules.
    """
    tests = [F.expr(t).alias(n) for n, t in TESTS.items()]
    rows = (labelled.where("bad is not null").select("doc_id", "bad", *tests, F.xxhash64("doc_id").alias("draw"))
            .orderBy("draw", "doc_id", *TESTS).limit(max_rows).toArrow())
    stats = {n: rows.column(n).to_numpy() for n in TESTS}
    bad = rows.column("bad").to_numpy(zero_copy_only=False).astype(bool)
    for_pruning = rows.column("draw").to_numpy() % 3 == 0
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), dtype=bool)

    def precise(rule: list[Condition], part: np.ndarray, least: int) -> bool:
        inside = _covers(rule, stats) & part & left
        return bad[inside].sum() >= least and bad[inside].mean() >= min_precision

    while len(rules) < max_rules:
        grow, prune = left & ~for_pruning, left & for_pruning
        rule = _grow({n: v[grow] for n, v in stats.items()}, bad[grow])
        rule = _prune(rule, {n: v[prune] for n, v in stats.items()}, bad[prune])
        if not rule or not precise(rule, ~for_pruning, min_rows) or not precise(rule, for_pruning, 1):
            break
        rules.append(rule)
        left &= ~_covers(rule, stats)
    return rules


def rule_number(rules: list[list[Condition]]) -> Column:
    """One conditional expression: the number of the first rule that holds, from 1, or null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(k)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """Statistics of every document and whether it stays.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. The learned list
    (``learn_rules`` on ``labels`` with ``doc_id`` and ``quality``; 0 is bad, a null quality teaches nothing)
    rejects further documents; ``rule`` is the rule that did. One row for each input row: repeated rows and ids
    give repeated rows, null ids stay null and meet no label, no words at all fail the base.
    """
    stats = write_shared(text_stats(docs), "text_stats")
    marks = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.min("quality") == 0).alias("bad")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    to_learn = stats.where(~failed).dropDuplicates(["doc_id"])  # the list judges only what the base leaves
    rules = learn_rules(to_learn.join(marks, "doc_id"), **learning)
    return (stats.withColumn("base_failed", failed).withColumn("rule", rule_number(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
