"""Results per key when a few keys hold most rows.

Every aggregate here is algebraic: each task folds its rows into a bounded hash table of
mergeable states (Spark's partial aggregation, which spills or passes rows on when full), and
only those states are shuffled. A key with a third of all rows thus arrives as one small state
per map task. Nothing gathers the rows of a key in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key_value, n) for every key, NULL included.

    An empty table gives no rows. The key may be of any type; it comes out as text.
    """
    return df.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, key: str, share: tuple[int, int] = (1, 50)) -> DataFrame:
    """Keys that hold at least ``share[0] / share[1]`` of all rows of df.

    NULL is no key, but its rows count in the total. The comparison is exact (integers).
    """
    counts = key_counts(df, key)
    total = df.select(F.count(F.lit(1))).scalar()  # reads no column
    part, whole = share
    return counts.filter(F.col("key_value").isNotNull() & (F.col("n") * F.lit(whole) >= total * F.lit(part)))


def key_summary(df: DataFrame, key: str, distinct: Sequence[str], first_last: str) -> DataFrame:
    """Rows, exact distinct values and first and last time of each key.

    Distinct counts go in two levels: (key, value) pairs are deduplicated first, which spreads a
    hot key over all tasks by its values, and only then counted. NULL values count as no value;
    rows with a NULL key are left out, as they belong to no key.
    """
    keyed = df.filter(F.col(key).isNotNull())
    out = keyed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(first_last).alias("first_seen"), F.max(first_last).alias("last_seen")
    )
    for c in distinct:
        pairs = keyed.select(key, c).distinct()
        out = out.join(pairs.groupBy(key).agg(F.count(c).alias(f"n_{c}")), key, "left")
    return out


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], k: int, n_rows: int = 0) -> DataFrame:
    """The first k rows of each key in the given order, hot keys included.

    Two rounds of row_number: within (key, salt), where the salt is a hash of the whole row, so
    that a hot key is ranked by many tasks; then within the key among at most k rows per salt. There is a salt per
    million of n_rows, the rows expected in all, and 32 at least.
    ``order`` must end in a unique column for a defined result among ties. Rows with a NULL key
    form a group of their own.
    """
    from pyspark.sql import Window as W

    salts = max(32, n_rows // 1_000_000)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
    first = salted.withColumn("__rn", F.row_number().over(W.partitionBy(key, "__salt").orderBy(*order))).filter(F.col("__rn") <= k)
    return (
        first.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
        .filter(F.col("__rn") <= k)
        .withColumnRenamed("__rn", "rank")
        .drop("__salt")
    )
