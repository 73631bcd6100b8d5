"""Segment pipelines for time-stamped audio on PySpark.

Every operator is a function from DataFrame to DataFrame (or Column to Column); nothing is
collected on the driver unless a docstring says so and gives the bound.
"""

from segtide.session import configure, new_session, shared_dir

__all__ = ["configure", "new_session", "shared_dir"]
