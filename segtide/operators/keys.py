"""Key sides of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per key, for the right side of a join on these keys.

    Copies combine in every task first. Adaptive execution splits a hot key of the other side
    only if both sides come straight from shuffles made for the join. The hash in the grouping
    keeps this aggregate's shuffle from standing in for that one; the second shuffle moves one
    row per key.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    if aggregates:
        return hashed.groupBy(*keys, "_hash").agg(*aggregates).drop("_hash")
    return hashed.select(*keys, "_hash").distinct().drop("_hash")
