"""A corpus made ready for training in five stages, each written and read again before the next."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.llm import bpe, crf, decontam, langid, superminhash
from segtide.llm.tables import write_shared


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` isn't in ``ids``; the ids are written first, so that Spark knows whether they are few."""
    return docs.join(write_shared(ids, "dropped_ids"), "doc_id", "left_anti").select(docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter, and those whose nearest codeword has a probability below 0.4,
    go. A null ``lang`` becomes the language found."""
    found = langid.identify(docs, langid.train(docs), ambiguous_below=0.4)
    return (found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
            .withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies; of rows that share an id one stays."""
    groups = write_shared(superminhash.near_duplicates(docs), "near_duplicates")
    out = _without(docs, groups.where("not kept").select("doc_id").distinct())
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"]))
    return out.withColumn("_row", first).where("_row = 1 or doc_id is null").drop("_row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return _without(docs, decontam.contaminated(docs, benchmark).select("doc_id").distinct())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; ``n_chars`` follows where the text changed."""
    found = crf.find_personal_data(docs)
    changed = F.size("spans") > 0
    return (found.withColumn("n_chars", F.when(changed, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars")))
            .withColumn("text", F.col("redacted")).select(docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256`` and the ``text`` that the ids decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, bpe.token_table(spark, "file://" + os.path.abspath(ranks)))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.col("decoded").cast("string").alias("text"))


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("token_ids", token_ids)]

ORACLE_SQL = None  # no SQL says what a classifier, a latent space or a tokenizer decides; tests hold the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
