"""Ranking, deduplication, portable sampling, streaks and calendars. Every order ends in a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.tables import small
from weftline.operators import keyed


def top_n(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per group, with rank; hot groups are ranked in salted parts first."""
    return keyed.top_per_key(df, by, order, n)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in order (nulls last), as one struct minimum, combined map-side.

    order must tell rows apart; among full ties the smallest remaining columns win.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    # a struct compares null first; a flag before each column turns that to last
    marked = F.struct(*[x for c in (*order, *rest) for x in (F.col(f"`{c}`").isNull().alias(f"__null_{c}"), F.col(f"`{c}`").alias(c))])
    first = df.groupBy(*by).agg(F.min(marked).alias("__m"))
    return first.select(*[F.col(f"`{c}`") if c in by else F.col(f"__m.`{c}`").alias(c) for c in df.columns])


def row_numbers(df: DataFrame, by: str, order: str, name: str, hot_rows: int = 1_000_000, parts: int = 64) -> DataFrame:
    """df with the number of each row within its key, from 1, in the order of a numeric column unique within the key.

    A key with more than hot_rows rows is cut into ranges of about equal numbers of rows, which are numbered apart and
    moved on by the rows before them, so no task orders a hot key as a whole. Rows with a NULL key are a key of their own, not cut.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > hot_rows) & F.col(by).isNotNull()).select(by)
    hot = df.join(small(sizes), by, "left_semi")
    cuts = hot.groupBy(by).agg(F.percentile_approx(order, [(i + 1) / parts for i in range(parts - 1)], 20 * parts).alias("__cuts"))
    part = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))
    marked = df.join(small(cuts), by, "left").withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(part))
    in_part = marked.filter("__cuts is not null").groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = in_part.withColumn("__before", F.sum("__n").over(W.partitionBy(by).orderBy("__part")) - F.col("__n")).drop("__n")
    numbered = marked.withColumn("__rn", F.row_number().over(W.partitionBy(by, "__part").orderBy(order)))
    joined = numbered.join(small(before), [by, "__part"], "left")
    return joined.select(*df.columns, (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def dense_ranks(df: DataFrame, by: str, order: Column, name: str = "wave") -> DataFrame:
    """df with the dense rank of ``order`` within each key; NULL orders rank first.

    Ranks depend on distinct values alone, so those are ranked and joined back: a hot key costs as
    many sorted rows as it has distinct values, not rows.
    """
    marked = df.withColumn("__o", order)
    distinct = marked.select(F.col(by).alias("__k"), F.col("__o").alias("__d")).distinct()
    ranked = distinct.withColumn(name, F.row_number().over(W.partitionBy("__k").orderBy("__d")))
    return marked.join(ranked, F.col(by).eqNullSafe(F.col("__k")) & F.col("__o").eqNullSafe(F.col("__d"))).drop("__k", "__d", "__o")


def portable_hash(key: Column, seed: int = 0, modulus: int = 1_000_003) -> Column:
    """Spread of an integer key below modulus that any engine computes alike."""
    k = F.pmod(key.cast("long"), F.lit(modulus))
    return F.pmod(F.pmod(k * F.lit(7919) + F.lit(seed * 104729 + 12345), F.lit(modulus)) * F.lit(6007) + F.lit(31), F.lit(modulus))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, the same on every engine and run."""
    return df.filter(portable_hash(F.col(key), seed) < int(fraction * 1_000_003))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, or all if there are fewer, by hash order: the same on every engine and run."""
    return df.withColumn("__h", portable_hash(F.col(key), seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with split 'train' or 'test': exactly floor(fraction * n) of each label train.

    The threshold per label comes from counts per hash value (at most the modulus), so no label is
    sorted as a whole; ties at the threshold go by key, and only they are ranked.
    """
    h = df.withColumn("__h", portable_hash(F.col(key), seed))
    per = h.groupBy(label, "__h").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(label).orderBy("__h")
    cum = per.withColumn("__before", F.sum("__c").over(w) - F.col("__c")).withColumn("__want", F.floor(F.sum("__c").over(W.partitionBy(label)) * F.lit(fraction)))
    # the one hash value per label within which the threshold falls; none where all rows are train
    edge = cum.filter("__before <= __want and __before + __c > __want").select(F.col(label).alias("__l"), F.col("__h").alias("__g"), (F.col("__want") - F.col("__before")).alias("__left"))
    joined = h.join(small(edge), F.col(label).eqNullSafe(F.col("__l")), "left")
    rank = F.row_number().over(W.partitionBy(label).orderBy(key))
    side = F.when(F.col("__left").isNull(), "train").when(F.col("__g").isNull() | (F.col("__h") > F.col("__g")), "test").otherwise("train")
    clear = joined.filter("__h is not null and (__g is null or __h <> __g)").withColumn("split", side)
    tied = joined.filter("__h = __g").withColumn("split", F.when(rank <= F.col("__left"), "train").otherwise("test"))
    return clear.select(*df.columns, "split").unionByName(tied.select(*df.columns, "split"))


def stratified_sample(df: DataFrame, key: str, by: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly min(n, size) rows per group, by hash order."""
    h = df.withColumn("__h", portable_hash(F.col(key), seed))
    return keyed.top_per_key(h, by, [F.col("__h"), F.col(key)], n).drop("__h", "rank")


def recovery(df: DataFrame, by: str, slot: str, healthy: str, run: int = 3) -> DataFrame:
    """(by, recovered_slot): the first slot of the first run of ``run`` healthy slots in a row.

    Slots are consecutive numbers; a missing slot breaks a run. NULL where there is none.
    """
    w = W.partitionBy(by).orderBy(slot)
    good = df.filter(F.col(healthy)).withColumn("__island", F.col(slot) - F.row_number().over(w))
    runs = good.groupBy(by, "__island").agg(F.min(slot).alias("start"), F.count(F.lit(1)).alias("length"))
    found = runs.filter(F.col("length") >= run).groupBy(by).agg(F.min("start").alias("recovered_slot"))
    return df.select(by).distinct().join(found, by, "left")


def knee(df: DataFrame, by: str, step: str, rate: str, ok: str) -> DataFrame:
    """(by, knee): the highest rate among the steps before the first that fails."""
    first_bad = df.filter(~F.col(ok)).groupBy(by).agg(F.min(step).alias("__bad"))
    before = df.join(first_bad, by, "left").filter(F.col("__bad").isNull() | (F.col(step) < F.col("__bad")))
    return df.select(by).distinct().join(before.groupBy(by).agg(F.max(rate).alias("knee")), by, "left")


def first_last_change(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """(by, first_value, last_value, pct_change) by order; NULL or zero first gives no change."""
    key = F.struct(*order)
    out = df.groupBy(by).agg(F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"))
    return out.withColumn("pct_change", F.round(F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100, 4))


def monthly(df: DataFrame, at: str, unit: str = "month") -> DataFrame:
    """(period, n): rows per period between the first and the last, gaps as 0. NULL times drop."""
    counts = df.filter(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, at).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    step = {"month": "interval 1 month", "quarter": "interval 3 months", "day": "interval 1 day"}[unit]
    span = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).filter("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    return calendar.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


def reindexed(df: DataFrame, by: str, period: str, labels: Sequence[str], periods: Sequence[object]) -> DataFrame:
    """Counts for every given label and period, 0 where there are none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(label, p) for label in labels for p in periods], f"{by} string, {period} {dict(df.dtypes)[period]}")
    counts = df.groupBy(by, period).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counts, [by, period], "left").select(by, period, F.coalesce("n", F.lit(0)).alias("n"))


def annualized(df: DataFrame, by: str, at: str) -> DataFrame:
    """(by, n, months, per_year): count / distinct months * 12."""
    months = F.count_distinct(F.date_trunc("month", at))
    return df.groupBy(by).agg(F.count(at).alias("n"), months.alias("months")).withColumn("per_year", F.round(F.try_divide(F.col("n") * 12.0, F.col("months")), 4))
