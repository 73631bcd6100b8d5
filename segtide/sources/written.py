"""Tables in between, written below the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from segtide.session import shared_dir


def written(df: DataFrame, label: str, **seen: Column) -> tuple[DataFrame, dict]:
    """The rows of ``df`` from files, and aggregates of them taken while they were written.

    Later steps, and lost executors, start from the files, and Spark knows how large they are.
    """
    look = Observation() if seen else None
    path = shared_dir(df.sparkSession, label)
    (df.observe(look, *[c.alias(n) for n, c in seen.items()]) if look else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), look.get if look else {}
