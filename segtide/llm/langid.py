"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from segtide.llm.tables import release_memory, ship

BUCKETS = 4096  # hashed n-grams of three bytes
CHUNK = 1 << 20
UNDETERMINED = "und"

# letters of ASCII as they are, everything else of ASCII is a space; other bytes stay
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the counts of the whole text's three-byte grams, of length 1."""
    total = np.zeros(BUCKETS)
    for low in range(0, len(text), CHUNK):  # two characters of overlap keep most grams whole
        b = _FOLD[np.frombuffer(f" {text[max(low - 2, 0):low + CHUNK].lower()} ".encode(), np.uint8)]
        gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        gram = gram[gram != 0x202020]
        total += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    root = np.sqrt(total)
    return (root / max(np.linalg.norm(root), 1e-12)).astype(np.float32)


def codewords(classes: int, bits: int, seed: int = 7) -> np.ndarray:
    """A word of -1 and 1 for each class; of many random codes the one whose closest words differ most."""
    random = np.random.default_rng(seed)
    best, best_key = None, (-1, -1)
    for _ in range(300):
        code = random.integers(0, 2, (classes, bits)) * 2 - 1
        if classes > 1:
            flat = np.abs(code.sum(0)) == classes  # a bit must divide the classes
            code[random.integers(0, classes), flat] *= -1
        apart = (bits - code @ code.T) // 2
        pairs = apart[np.triu_indices(classes, 1)]
        key = (pairs.min(initial=bits), pairs.sum())
        if key > best_key:
            best, best_key = code, key
    return best


def _fit(x: np.ndarray, targets: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    """Logistic regressions of all bits at once, by gradient descent with momentum; the last row is the constant."""
    w = np.zeros((x.shape[1] + 1, targets.shape[1]), dtype=np.float32)
    speed = np.zeros_like(w)
    for _ in range(steps):
        margin = targets * (x @ w[:-1] + w[-1])
        pull = -targets * weights[:, None] / (1 + np.exp(np.clip(margin, -30, 30)))
        slope = np.vstack([x.T @ pull, pull.sum(0)]) + 1e-5 * w
        speed = 0.9 * speed - 4.0 * slope
        w = (w + speed).astype(np.float32)
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by logistic loss over the bits, its probability, and that of the next."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = share[np.arange(len(x)), best]
        share[np.arange(len(x)), best] = 0
        return best, top, share.max(1)


def train(docs: DataFrame, max_rows: int = 4000, max_languages: int = 500, steps: int = 200) -> Model | None:
    """Fit on a sample of at most ``max_rows`` rows with a text and a ``lang``, spread over the languages.

    The sample takes the rows of the smallest hashes of ``doc_id`` below a share for each language; rows with a null
    text, lang or id, or without a letter, teach nothing. None where there is nothing to learn from. The ``max_languages`` most
    frequent languages are learned.
    """
    ship(docs)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where("text is not null and lang is not null and doc_id is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    each = max(max_rows // len(counts), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bound = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1 << 40, (each << 40) // r["count"]))])
    sample = rows.where(place < bound[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()],
                                           pa.binary())], names=["lang", "x"])

    got = sample.select("lang", "text").mapInArrow(work, "lang string, x binary").limit(2 * max_rows).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if not names:
        return None
    at = {n: i for i, n in enumerate(names)}
    label = np.array([at[n] for n in got.column("lang").to_pylist()])
    x = np.stack([np.frombuffer(b, np.float16) for b in got.column("x").to_pylist()]).astype(np.float32)
    code = codewords(len(names), 15 + 5 * int(np.ceil(np.log2(max(len(names), 2)))))
    del got
    share = 1.0 / np.bincount(label)[label] / len(names)
    weights = _fit(x, code[label].astype(np.float32), share.astype(np.float32), steps)
    del x
    release_memory()  # a driver goes on to other work
    return Model(names, code, weights)


RESULT = ["lang_pred", "score", "ambiguous", "runner_up_score"]


def identify(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.6) -> DataFrame:
    """Add ``lang_pred, score, ambiguous, runner_up_score`` to every row, from its whole text.

    ``lang_pred`` is ``und`` (score 0) for a null text, a text without a letter, or without a model; ``ambiguous`` marks
    results whose codeword is not clearly nearest (score below ``ambiguous_below``). Rows stay as they are, repeated ones and
    null ids too; columns that have one of the new names are replaced.
    """
    ship(docs)
    docs = docs.drop(*RESULT)
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_languages and BUCKETS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        letter = regex.compile(r"\p{L}").search
        known = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = part.column(text_at).to_pylist()
                names, scores, seconds = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                good = [i for i, t in enumerate(texts) if known is not None and t and letter(t)]
                if good:
                    best, top, second = known.decode(np.stack([features(texts[i]) for i in good]))
                    for i, b in zip(good, best):
                        names[i] = known.languages[b]
                    scores[good], seconds[good] = top, second
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names), pa.array(scores), pa.array(scores < ambiguous_below), pa.array(seconds)],
                    names=[*part.schema.names, *RESULT])

    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType()),
           StructField("runner_up_score", DoubleType())]
    return docs.mapInArrow(work, StructType([*docs.schema, *new]))
