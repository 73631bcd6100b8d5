"""Check queries of the ten operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.llm import bitplanes, bpe, counts, crf, decontam, langid, mixing, periodic, rules, suffix, superminhash, variants, warc
from segtide.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, bpe.token_table(spark, "file://" + os.path.abspath(ranks)))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive_pages(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token_files")
    bitplanes.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return bitplanes.digest(bitplanes.read_token_files(spark, path))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.digest(crf.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents"), alter=variants.forget_letters))


def planted(docs: DataFrame) -> DataFrame:
    """In a tenth of the documents, chosen by the checksum of the id, the words repeat with one period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))  # null or size -1 or null elsewhere
    a = (g % F.col("_n")).cast("int")
    p = (1 + F.call_function("div", F.col("_n") - a, 3 + g % 8)).cast("int")
    times = F.call_function("div", F.col("_n") - a, p).cast("int") + 1
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), times)), 1, F.col("_n") - a)
    changed = F.array_join(F.concat(F.slice("_words", 1, a), again), " ")
    return chosen.withColumn("text", F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, changed).otherwise(F.col("text"))).drop("_words", "_n")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_near_dedup": op5_near_dedup,
    "op6_repeated_strings": op6_repeated_strings,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

# A source is stopped where the level reached when those of smaller size per weight have been stopped is still above it.
ORACLES: dict[str, str] = {"op13_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS draw
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, sum(source_size) OVER () AS total
  FROM sums),
levels AS (
  SELECT *, 3 * total - 4 * (sum(source_size) OVER (ORDER BY 10 * source_size // weight, source NULLS LAST) - source_size) AS rest,
         sum(weight) OVER () - (sum(weight) OVER (ORDER BY 10 * source_size // weight, source NULLS LAST) - weight) AS open
  FROM weighed),
stopped AS (SELECT *, rest * weight > 4 * source_size * open AS stop FROM levels),
goal AS (
  SELECT source, source_size,
         CASE WHEN stop THEN 2.0::DOUBLE * source_size
              ELSE weight::DOUBLE * (3 * total - 4 * coalesce(sum(source_size) FILTER (stop) OVER (), 0))::DOUBLE
                   / (2 * sum(weight) FILTER (NOT stop) OVER ())::DOUBLE END AS target
  FROM stopped),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, s.draw, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated"""}
