"""Regular steps as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # steps per generated array


def explode_steps(df: DataFrame, first: Column, last: Column, step: int, out: str) -> DataFrame:
    """One row per ``first``, ``first + step``, ... up to and including ``last``; none if it is earlier.

    Generated in two levels, so that a very long row never becomes one very long array.
    """
    # the bounds are kept in order: Spark may fold constant ones before the filter drops the row
    blocks = F.sequence("_step_first", F.greatest("_step_first", "_step_last"), F.lit(step * BLOCK))
    end = F.least(F.col("_step_block") + step * (BLOCK - 1), F.col("_step_last"))
    return (df.withColumn("_step_first", first).withColumn("_step_last", last).where("_step_first <= _step_last")
            .withColumn("_step_block", F.explode(blocks))
            .withColumn(out, F.explode(F.sequence("_step_block", F.greatest("_step_block", end), F.lit(step))))
            .drop("_step_first", "_step_last", "_step_block"))
