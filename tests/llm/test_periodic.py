"""Periodic runs against brute force, and the query against a plain rewriting of its contract."""

import hashlib
import os
import random
import re
import zlib

import pytest

from segtide.llm import periodic
from segtide.llm.queries import op12_periodic_runs, planted
from tests.llm.conftest import rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)  # smaller periods came first
            i += 1
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def by_contract(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest())


def random_documents(draw, letters, longest):
    docs = []
    for _ in range(draw.randint(1, 6)):
        n = draw.randint(0, longest)
        words = [draw.choice("abcdefgh"[:letters]) for _ in range(n)]
        if n and draw.random() < 0.6:
            a, p = draw.randrange(n), draw.randint(1, 12)
            words = [words[min(a + (i - a) % p, n - 1)] if i >= a else words[i] for i in range(n)]
        docs.append(words)
    return docs


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 4), (3, 6), (5, 7), (4, 12), (4, 8), (6, 6)])
def test_all_runs_of_random_words(exponent, least):
    draw = random.Random(exponent * 100 + least)
    for _ in range(300):
        docs = random_documents(draw, draw.choice([1, 2, 3, 6]), 70)
        assert periodic.find_runs(docs, exponent, least) == [brute(d, exponent, least) for d in docs]


def test_nested_runs_and_powers():
    inner = ["a"] * 8 + ["b"]
    docs = [inner * 9 + ["c"], (["x", "y"] * 6 + ["z"]) * 5, ["q"] * 400, list("abcabcabcabca"), list("ab" * 40 + "c" + "ab" * 40)]
    assert periodic.find_runs(docs) == [brute(d) for d in docs]
    assert all(periodic.collapse(d, brute(d)) == kept(d, brute(d)) for d in docs)


def test_impossible_settings_are_refused():
    for exponent, least in ((2, 6), (4, 1)):
        with pytest.raises(ValueError):
            periodic.find_runs([["a"] * 9], exponent, least)


@pytest.mark.parametrize("name", ["messy", "no_rows"])
def test_operator_on_messy_rows(request, name):
    docs = request.getfixturevalue(name)
    got = periodic.periodic_runs(docs)
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        runs = brute(words)
        want.append((r.doc_id, len(words), runs, " ".join(kept(words, runs))))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_very_long_texts_in_small_groups(spark):
    """Groups of a few words and one text of 2.4 million, most of it one run."""
    rows = [(1, "la " * 600_000 + "end " + "so it goes " * 600_000), (2, "so it goes " * 5), (3, None), (4, "plain words only here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs, group_chars=1000).collect()}
    assert got == {1: [(0, 600_000, 1), (600_001, 1_800_000, 3)], 2: [(0, 15, 3)], 3: [], 4: []}


def test_query_as_its_contract_says(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    draw = random.Random(7)
    rows += [(10_000 + i, " ".join(draw.choice("abcde") for _ in range(draw.randint(0, 150)))) for i in range(300)]
    rows += [(None, "a " * 30), (None, None), (20_000, ""), (20_001, " \n"), (10_000, "b " * 9), (10_000, "b " * 9)]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_runs int, runs string").repartition(5).write.parquet(
        os.path.join(folder, "documents.parquet"))
    assert rows_of(op12_periodic_runs(spark, folder)) == sorted((by_contract(*r) for r in rows), key=repr)


def test_planted_words_are_those_of_the_contract(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(400)]
    changed = {r.doc_id: r.text.split() for r in planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = 0
    for doc_id, text in rows:
        h, words = zlib.crc32(str(doc_id).encode()), text.split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, hit = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], hit + 1
        assert changed[doc_id] == words
    assert hit > 20
