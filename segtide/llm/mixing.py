"""Mixing sources to target weights, in DataFrame functions only.

Tokens are added up per source, targets give each source a repetition rate, and a document is emitted
floor(rate) times plus once more with the probability of what is left of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segtide.llm.tables import shuffle_partitions, write_shared

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)       # all targets together: 150 % of all sizes, as a fraction of whole numbers
MAX_REPEAT = 2
DRAW_DIGITS = 13     # hexadecimal digits of a draw: 52 bits, exact in a double


def word_count(text: Column) -> Column:
    """Words of a text (null: 0). Every word becomes one letter, so no array of words is made."""
    letters = F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("bigint")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that only depends on the seed and the id; on the text where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16 ** DRAW_DIGITS))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the sources (one row each, ``source, source_size``) their weights: by code point, null last, repeating.

    Sources are cut into sorted ranges and written; a source's place is its place in the range plus the rows of the
    ranges before, so no task sees them all.
    """
    ranged = (sizes.repartitionByRange(shuffle_partitions(sizes), F.col("source").asc_nulls_last())
              .withColumn("_range", F.spark_partition_id()))
    ranged = write_shared(ranged, "mix_sources")
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    before = ranged.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    return ranged.join(before, "_range").select("source", "source_size", weight.cast("bigint").alias("weight"))


def targets(sources: DataFrame, share: tuple[int, int] = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to sources with a weight.

    All sources share ``share`` of all sizes by weight; a target stops at ``max_repeat`` times its source's size and the excess is
    shared again by weight, until none is above. Each round adds up the weights and sizes of the
    sources still open, two numbers, so the sources stay where they are. Sums are whole numbers: the result doesn't
    depend on their order.
    """
    num, den = share
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # level = share of one unit of weight = rest / (den * open), both whole numbers
    rest, open_weight, closed = num * total, 0, -1
    at_stop = None
    while True:
        now_stopped = F.lit(False) if at_stop is None else at_stop
        row = sources.agg(F.sum(F.when(now_stopped, F.col("source_size"))).alias("sizes"), F.count_if(now_stopped).alias("n"),
                          F.sum(F.when(~now_stopped, F.col("weight"))).alias("weights")).first()
        rest, open_weight = num * total - den * max_repeat * (row["sizes"] or 0), row["weights"] or 0
        if row["n"] == closed or not open_weight:
            break
        closed = row["n"]
        # above the stop: weight * rest / (den * open) > max_repeat * size
        at_stop = (F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(20,0)")
                   > F.col("source_size").cast("decimal(38,0)") * F.lit(max_repeat * den * open_weight).cast("decimal(18,0)"))
    stop = (F.col("source_size") * max_repeat).cast("double")
    if not open_weight:
        return sources.withColumn("target", stop)
    shared = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(den * open_weight))
    return sources.withColumn("target", F.when(now_stopped, stop).otherwise(shared))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
        max_repeat: int = MAX_REPEAT) -> DataFrame:
    """How often each row of ``docs`` (``doc_id, text, source``) is to be taken: adds ``size`` (words), ``source_size``, ``target`` (both its
    source's) and ``copies``; ``emit`` repeats the rows.

    A document is taken floor(target / source_size) times, plus once where its draw lies below the rest of that rate; never
    more than ``max_repeat`` times. Sizes combine in every task before the shuffle by source, and the sources, one row
    each, join the documents; Spark splits a hot source, and broadcasts the sources only where their written size is small.

    Null source: a source of its own, the last. Null or empty text: size 0, taken as its source is. A source without words has target 0 and
    copies 0. Rows that share an id share a draw; a null id is drawn by its text. Of columns with the names added
    here, the ones made here stay; others are kept. An empty table gives an empty one.
    """
    made = ("size", "source_size", "target", "copies")
    named = docs.drop(*made)
    # never-null stand-ins, so that a null source joins as a key like others
    keys = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source")]
    sized = named.select("*", word_count(F.col("text")).alias("size"), *keys)
    sums = sized.groupBy("_source", "_no_source").agg(F.sum("size").alias("source_size"))
    sums = sums.select(F.when(~F.col("_no_source"), F.col("_source")).alias("source"), "source_size")
    aimed = write_shared(targets(weighted_sources(sums, weights), share, max_repeat), "mix_targets").select(
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("bigint")
    return (sized.join(aimed, ["_source", "_no_source"]).withColumn("copies", whole + extra)
            .drop("_source", "_no_source"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix`` as often as it says, with the number of the ``copy`` from 0."""
    numbers = F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0)).cast("int"))
    return mixed.where("copies > 0").withColumn("copy", F.explode(numbers))
