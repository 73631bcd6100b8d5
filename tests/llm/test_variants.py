"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from segtide.llm import variants
from segtide.llm.queries import op11_spelling_variants
from tests.llm.conftest import rows_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if are_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()], key=repr)


def count_by_contract(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_index_finds_each_pair_once():
    draw = random.Random(3)
    for _ in range(150):
        letters = "abcdeé\U0001f600"[:draw.choice([2, 3, 7])]
        words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(1, 80))})
        index = variants.FmIndex(words)
        for whole in range(5):
            asked = [w for w in words if len(w) >= whole] + ["zz" + "a" * whole]
            q, found = variants.one_error(index, asked, whole)
            want = [(i, k) for i, a in enumerate(asked) for k, b in enumerate(words) if len(b) >= whole
                    and a[len(a) - whole:] == b[len(b) - whole:] and are_near(a[:len(a) - whole], b[:len(b) - whole])]
            assert sorted(zip(q.tolist(), found.tolist())) == want


def test_few_letters_many_letters_and_chains(spark):
    """Small parts and crowded halves in many blocks; chains of forms; words of one letter and of 3,000; other scripts."""
    draw = random.Random(5)
    counts = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))): draw.choice([1, 3, 10, 90, 2000]) for _ in range(300)}
    counts |= {"chainaa": 2, "chainab": 20, "chainbb": 200, "chainbbc": 2000, "chainbbcd": 20_000, "hain": 10**12, "x" * 3000: 5, "x" * 2999 + "y": 500,
               "中文字": 1, "中文": 10, "\U0001f600\U0001f601": 1, "\U0001f600": 30, "tied-a": 50, "tied-b": 50, "tied-c": 5}
    rows = [(w, n) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n bigint").repartition(5)
    for part_rows, half_words in ((20_000, 50_000), (50, 7)):
        assert rows_of(variants.spelling_variants(df, 10, part_rows, half_words).select(COLUMNS)) == brute(counts)


def test_repeated_null_and_no_words(spark):
    schema = "word string, n bigint, root string, best string"
    rows = [("banana", 5, "x", None), ("banana", 15, "y", None), ("bananas", 2, None, None), (None, 9, None, None), ("zero", 0, None, None), ("none", None, None, None)]
    got = variants.spelling_variants(spark.createDataFrame(rows, schema))
    assert rows_of(got) == [("banana", None, "banana", 20, 1, None), ("bananas", "banana", "banana", 2, 1, 20)]
    assert rows_of(variants.spelling_variants(spark.createDataFrame([], schema))) == []
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], schema), ratio=1)


@pytest.mark.parametrize("name", ["messy", "no_rows", "documents"])
def test_counts_of_messy_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = variants.word_counts(docs, alter=variants.forget_letters)
    assert {r.word: r.n for r in got.collect()} == count_by_contract(rows)


def test_query_is_brute_force_over_all_pairs(spark, tmp_path):
    draw = random.Random(9)
    base = ["".join(draw.choice("abcdefghé×ÿ") for _ in range(draw.randint(6, 10))) for _ in range(40)]
    rows = []
    for d in range(400):
        words = [draw.choice(base) for _ in range(draw.randint(0, 30))]
        words = [w if draw.random() > 0.05 else w[:3] + draw.choice("abxyZ") + w[4:] for w in words]
        rows.append((d, " ".join(w.upper() if draw.random() < 0.1 else w for w in words)))
    rows += [(None, "Straße STRAßEN straßen İstanbul caféterias"), (None, None), (7, ""), (500, "caféterias " * 30 + "中abcdefg中abcdefg" * 9), (500, "q" * 50_000 + " " + "q" * 50_000)]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int").repartition(4).write.parquet(folder + "/documents.parquet")
    assert rows_of(op11_spelling_variants(spark, folder).select(COLUMNS)) == brute(count_by_contract(rows))
