"""Near copies and repeated strings against brute force."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtide.llm import suffix, superminhash
from tests.llm.conftest import rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted([(d, len(shingles(t)), root(d) if d is not None else None, d is None or root(d) == d) for d, t in rows], key=repr)


@pytest.mark.parametrize("table", ["messy", "documents", "no_rows"])
def test_groups_are_those_of_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    assert rows_of(superminhash.near_duplicates(docs)) == brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_group_of_near_copies(spark):
    """Chains and outsiders of one text: found without all pairs."""
    base = [f"w{i}" for i in range(60)]
    draw, rows = np.random.default_rng(5), []
    for d in range(150):
        words = list(base)
        for i in draw.choice(60, d % 6, replace=False):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    assert rows_of(superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_groups(rows)


@pytest.mark.parametrize("m", [100, 400])
def test_links_grow_with_the_members(spark, monkeypatch, m):
    """A first document that is near none of the group, and groups of near copies near no other group: links stay
    linear in the members, and the groups are those of all pairs."""
    counts = {}
    real = superminhash.write_shared

    def counted(df, label):
        out = real(df, label)
        if label == "links":
            counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(superminhash, "write_shared", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base[:158] + [f"f{i}" for i in range(42)]))]  # about 0.68 of the others
    rows += [(1 + d, " ".join(base[:199] + [f"x{d}"])) for d in range(m)]
    other = [f"w{i}" if i % 9 else f"y{i}" for i in range(200)]
    rows += [(1000 + d, " ".join(other[:199] + [f"z{d}"])) for d in range(m // 4)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(0, 0)] + [(d, 1) for d in range(1, m + 1)] + [(d, 1000) for d in range(1000, 1000 + m // 4)]
    assert counts["links"] <= 3 * len(rows)


def test_ids_shared_by_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, b), (3, a), (3, b)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    common, only = draw.integers(0, 2**63, 400, dtype=np.uint64), draw.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.concatenate([common, only[:100]]), np.concatenate([common, only[100:]])]
    sig = superminhash.super_min_hash(np.concatenate(sets), np.repeat([0, 1], [500, 500]), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.15
    small = superminhash.super_min_hash(np.array([5], dtype=np.uint64), np.array([0]), 1, 128)
    assert np.isfinite(small).all() and sorted(np.floor(small[0])) == list(range(128))  # a permutation: one place a level


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (300, 100), (300, 250)]
    got = superminhash.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(5))
    assert rows_of(got) == sorted([(i, 0) for i in range(1, 61)] + [(200, 100), (250, 100), (300, 100)], key=repr)


def brute_removal(rows):
    """Rows in order of id, null first."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(b[i:i + 100])
        out.append((d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()),
                    np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def removed(df):
    return sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect()], key=repr)


@pytest.mark.parametrize("table, group_rows", [("messy", 20_000), ("documents", 20_000), ("documents", 1), ("no_rows", 20_000)])
def test_repeats_are_those_of_all_windows(request, table, group_rows):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert removed(suffix.remove_repeats(docs, group_rows)) == brute_removal(rows)


def test_periodic_and_overlapping_strings(spark):
    draw = np.random.default_rng(2)
    text = "".join(chr(97 + c) for c in draw.integers(0, 26, 700))
    rows = [(1, "ab" * 300), (2, text[:350]), (3, text[200:500]), (4, text[251:350]), (5, text[250:350] + "-" + text[251:351]),
            (6, "ba" * 150), (7, text), (8, text[:99]), (9, text[40:139] + "!" + text[41:141])]
    assert removed(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_removal(rows)


def test_multikey_order_is_the_sorted_order():
    words = np.random.default_rng(3).integers(0, 3, (500, 5), dtype=np.uint64)
    order, run = suffix.multikey_order(words)
    listed = [tuple(w) for w in words.tolist()]
    assert [listed[i] for i in order] == sorted(listed)
    assert len(set(run.tolist())) == len(set(listed))


def test_chunks_cover_every_window_once():
    data = np.random.default_rng(4).integers(97, 100, 5000).astype(np.uint8)
    _, first, anchor, n = suffix.chunks_of(data)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == 5000 - suffix.LENGTH + 1
    assert ((anchor >= first + n - 1) & (anchor <= first + suffix.LENGTH - suffix.GRAM)).all()
