"""Joins with small tables, their size checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any script.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def trimmed(c: Column) -> Column:
    """Text without white space around it, of any kind; linear however long a run of it is."""
    return F.btrim(c, F.lit(WHITE))


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is, so that Spark
    joins by shuffle. Counts no more than max_rows + 1 rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
