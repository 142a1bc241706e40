"""Mixing sources to target weights with hash-threshold histograms.

Sizes are tokens. The size of the mixture is the largest at which every source that has texts
reaches its share with no text used more often than its source allows; shares of sources without
texts go to the others in proportion. A source's budget is then a number of whole passes over
its texts and a rest. Which texts serve once more is decided by a hash of their id, whatever their length: those
from a start up to a threshold, hashes being a circle. The threshold comes from a histogram of tokens by source and hash bucket; only the
bucket in which the rest runs out is split again, until it holds one text, which is taken if more than half of it is
missing. The same histogram serves STARTS starts, each with its own threshold, and the one that comes nearest
to the budget is kept: half of one text is the most that can be missed, and with so many starts it is a few tokens. Selecting
is then a filter: nothing is sorted, and no source is gathered.

Sums by source and bucket combine on the map side, so a source with a third of all rows costs
no more than another; per level STARTS rows per target source reach the driver. Texts without tokens
(NULL, empty) are not selected: they add nothing to any share. Rows whose source is NULL or has
no target are left out. A target source given twice counts with its summed share and smallest
cap; a cap below 1 selects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS, LEVELS = 12, 5
CIRCLE = 1 << BITS * LEVELS
STARTS = 64


@dataclass
class Share:
    source: str
    target: float
    cap: int
    docs: int = 0
    tokens: int = 0
    passes: int = 0
    rest: int = 0
    start: int = 0
    length: int = 0  # texts with a hash from start on, for this length of the circle, serve once more


def with_hash(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """df with h, a hash of the id of BITS * LEVELS bits, never negative."""
    return df.withColumn("h", F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit(CIRCLE - 1)))


def budgets(sizes: DataFrame, targets: DataFrame, max_sources: int = 10_000) -> list[Share]:
    """Whole passes and rest of each target source. The targets are a small table of settings."""
    wanted = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("t"), F.min("max_repeats").alias("cap"))
    rows = wanted.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    totals = sizes.join(F.broadcast(wanted.select("source")), "source").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    have = {r.source: r for r in totals.collect()}  # at most one row per target source
    shares = [Share(r.source, float(r.t or 0), int(r.cap or 0)) for r in sorted(rows, key=lambda r: r.source)]
    for s in shares:
        if s.source in have:
            s.docs, s.tokens = have[s.source].docs, have[s.source].tokens
    usable = [s for s in shares if s.tokens > 0 and s.target > 0 and s.cap > 0]
    if usable:
        whole = sum(s.target for s in usable)
        size = min(s.cap * s.tokens * whole / s.target for s in usable)
        for s in usable:
            budget = min(round(size * s.target / whole), s.cap * s.tokens)
            s.passes, s.rest = divmod(budget, s.tokens)
    return shares


def _first_ends(sums: DataFrame) -> DataFrame:
    """(source, start, bucket, left, tokens, docs): for each start the first-level bucket in which the rest runs out."""
    starts = np.arange(STARTS) << (BITS - (STARTS - 1).bit_length())

    def run(buckets: pd.DataFrame) -> pd.DataFrame:
        b = buckets.sort_values("bucket")
        # twice around the circle
        upto, total = np.concatenate([np.cumsum(b.tokens), np.cumsum(b.tokens) + b.tokens.sum()]), b.tokens.sum()
        first = np.searchsorted(b.bucket.to_numpy(), starts)
        before = np.where(first > 0, upto[first - 1], 0)
        goal = before + b.missing.iloc[0]
        at = np.searchsorted(upto, goal, side="right")
        tokens, docs = np.tile(b.tokens, 2)[at], np.tile(b.docs, 2)[at]
        bucket = np.concatenate([b.bucket, b.bucket + (1 << BITS)])[at]
        return pd.DataFrame({"source": b.source.iloc[0], "start": starts, "bucket": bucket, "left": goal - (upto[at] - tokens), "tokens": tokens, "docs": docs})

    return sums.groupBy("source").applyInPandas(run, "source string, start long, bucket long, left long, tokens long, docs long")


def find_thresholds(sizes: DataFrame, shares: list[Share]) -> None:
    """Set the start and length of each share so that the texts between hold its rest as near as any of STARTS starts allows."""
    by_name = {s.source: s for s in shares}
    rests = [(s.source, s.rest) for s in shares if s.rest > 0]
    if not rests:
        return
    spark, counted = sizes.sparkSession, sizes.filter("n_tokens > 0").select("source", "h", "n_tokens")
    found: dict[str, list] = {}
    sums = [F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")]
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift).alias("bucket")
        if level == 0:
            asked = spark.createDataFrame(rests, "source string, missing long")  # one row per target source
            # at most 2 ** BITS rows per source
            ends = _first_ends(counted.join(F.broadcast(asked), "source").groupBy("source", "missing", bucket).agg(*sums))
        else:
            # STARTS rows per target source; a prefix past the end of the circle is the one at its beginning
            asked = spark.createDataFrame(open_at, "source string, start long, prefix long, missing long")
            inside = counted.withColumn("__p", F.shiftright("h", shift + BITS)).join(
                F.broadcast(asked.withColumn("__p", F.pmod("prefix", F.lit(1 << BITS * level)))), ["source", "__p"]
            )
            each = inside.groupBy("source", "start", "prefix", "missing", bucket).agg(*sums)
            before = F.sum("tokens").over(W.partitionBy("source", "start").orderBy("bucket")) - F.col("tokens")
            ends = each.withColumn("left", F.col("missing") - before).filter("left >= 0 and left < tokens")
            ends = ends.withColumn("bucket", F.shiftleft("prefix", BITS) + F.pmod("bucket", F.lit(1 << BITS)))
        open_at = []
        for r in ends.select("source", "start", "bucket", "left", "tokens", "docs").collect():
            if r.left and r.docs > 1 and level < LEVELS - 1:
                open_at.append((r.source, r.start, r.bucket, r.left))
            else:
                over = 2 * r.left > r.tokens
                first = r.start << BITS * (LEVELS - 1)
                found.setdefault(r.source, []).append((r.tokens - r.left if over else r.left, first, ((r.bucket + over) << shift) - first))
        if not open_at:
            break
    for source, ways in found.items():
        _, by_name[source].start, by_name[source].length = min(ways)


def select(sizes: DataFrame, shares: list[Share], spark: SparkSession) -> DataFrame:
    """sizes with copies, the times each text is used; texts that aren't used are left out."""
    plan = spark.createDataFrame([(s.source, s.passes, s.start, s.length) for s in shares], "source string, __passes long, __start long, __length long")
    more = F.pmod(F.col("h") - F.col("__start"), F.lit(CIRCLE)) < F.col("__length")
    # the plan has one row per target source
    chosen = sizes.filter("n_tokens > 0").join(F.broadcast(plan), "source").withColumn("copies", (F.col("__passes") + more.cast("long")).cast("int"))
    return chosen.filter("copies > 0").drop("__passes", "__start", "__length")


def report(chosen: DataFrame, shares: list[Share], spark: SparkSession) -> DataFrame:
    """The share reached by each target source, beside what was asked and what there is."""
    schema = "source string, target_share double, max_repeats int, available_docs long, available_tokens long"
    asked = spark.createDataFrame([(s.source, s.target, s.cap, s.docs, s.tokens) for s in shares], schema)
    got = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    total = got.select(F.sum("tokens")).scalar()
    return asked.join(F.broadcast(got), "source", "left").select(
        "source", "target_share", "max_repeats", "available_docs", "available_tokens",
        F.coalesce("docs", F.lit(0)).alias("selected_docs"), F.coalesce("tokens", F.lit(0)).alias("selected_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("reached_share"),
    )
