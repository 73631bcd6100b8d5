"""The mix of sources against a plain water level, SQL and the emitted rows."""

import hashlib
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from segtide.llm import mixing
from segtide.llm.queries import ORACLES, op13_mixing
from tests.llm.conftest import rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, seed="mix", weights=(5, 2, 1), share=Fraction(3, 2), stop=2):
    """Shares by rounds, in fractions, as one would on paper."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = {}
    for n, (_, _, s) in zip(size, rows):
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, opened, rest = {}, set(order), share * sum(size)
    while opened:
        each = {s: rest * weight[s] / sum(weight[o] for o in opened) for s in opened}
        over = {s for s in opened if each[s] > stop * total[s]}
        if not over:
            goal.update(each)
            break
        for s in over:
            goal[s] = Fraction(stop * total[s])
            rest -= goal[s]
        opened -= over
    out = []
    for n, (d, t, s) in zip(size, rows):
        rate = goal[s] / total[s] if total[s] else Fraction(0)
        name = str(d) if d is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) / 16 ** 13
        out.append((d, n, total[s], float(goal[s]), int(rate) + (u < float(rate) - int(rate))))
    return sorted(out, key=repr)


CASES = {
    "plain": [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(200)],
    "small sources stop": [(i, "w " * 40, "big") for i in range(60)] + [(100 + i, "a b", c) for i, c in enumerate("xyzuv")],
    "nulls, ties, repeats": [(1, "a b", None), (1, "a b", None), (None, "a b c", None), (None, None, "é"), (2, "", "Z"), (3, " \t\n\x0b\x0c\r ", "a"),
                             (4, "x y z w", "a"), (5, "one", ""), (6, None, "only null"), (7, "é 中文 \U0001f600", "\U0001f600"), (8, "two words", "￿")],
    "one source": [(i, "w " * i, "s") for i in range(20)],
    "no words": [(1, None, "a"), (2, " ", None)],
    "none": [],
}


@pytest.mark.parametrize("name", list(CASES))
def test_as_on_paper(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id bigint, text string, source string, size int, copies string").repartition(3)
    mixed = mixing.mix(docs)
    got = sorted((tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", "copies").collect()), key=repr)
    assert got == brute(rows)
    emitted = mixing.emit(mixed).groupBy(F.col("doc_id").isNull()).count().collect()
    assert sum(r["count"] for r in emitted) == sum(r[4] for r in got)


def test_very_long_text_and_hot_source(spark):
    rows = [(0, "word " * 2_000_000, "hot")] + [(i, "a b c", "hot") for i in range(1, 400)] + [(1000 + i, "d " * 500, f"c{i % 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "copies")
    assert rows_of(got) == brute(rows)


def test_query_is_its_sql_and_near_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    got = op13_mixing(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert rows_of(got) == sorted(con.execute(ORACLES["op13_mixing"]).fetchall(), key=repr)
    assert rows_of(got) == rows_of(op13_mixing(spark, folder))
    sums = got.agg(F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    words = got.agg(F.sum("size")).first()[0]
    assert abs(sums[0] - 1.5 * words) < 0.02 * words and sums[1] <= 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source")
    rate = F.col("target") / F.col("source_size")
    chance = F.sum((rate - F.floor(rate)) * (1 - rate + F.floor(rate)) * F.col("size") * F.col("size"))  # variance of independent draws
    for r in got.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), chance.alias("chance")).collect():
        assert abs(r.taken - r.target) <= 4 * r.chance ** 0.5 + 1e-6


def test_no_python_in_the_plan(spark, documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
