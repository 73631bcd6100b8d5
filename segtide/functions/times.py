"""Time helpers. Instants are compared as integer microseconds since the epoch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(delta: timedelta | int) -> int:
    """A duration as whole microseconds."""
    return delta if isinstance(delta, int) else delta // timedelta(microseconds=1)


def us(col: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp of either kind (session zone UTC)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


def from_us(col: Column | str, ntz: bool = True) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.timestamp_micros(col)
    return out.cast("timestamp_ntz") if ntz else out


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def type_of(df: DataFrame, name: str) -> str:
    """``timestamp`` or ``timestamp_ntz``: literals take the column's own type, so that
    a comparison needs no cast on the column and reaches the scan."""
    return "timestamp_ntz" if is_ntz(df, name) else "timestamp"


def instant(value: datetime | Column, kind: str) -> Column:
    if isinstance(value, Column):
        return value.cast(kind)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)


def slot_start(time_us: Column, width: timedelta | int, origin: int = 0) -> Column:
    """Start (in microseconds) of the fixed-width slot that holds an instant."""
    width = micros(width)
    return time_us - F.pmod(time_us - F.lit(origin), F.lit(width))


def slot_number(time_us: Column, width: timedelta | int, origin: int = 0) -> Column:
    """Whole number of the slot; exact integer division, also before the origin."""
    width = micros(width)
    shifted = time_us - F.lit(origin)
    return F.call_function("div", shifted - F.pmod(shifted, F.lit(width)), F.lit(width))
