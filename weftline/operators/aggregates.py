"""Aggregates with named definitions: shares, percentiles, metrics, crosstabs and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_share(df: DataFrame, by: Sequence[str], digits: int = 1) -> DataFrame:
    """(by, n, pct): rows of each group and their percentage of all rows.

    Only the groups, not the rows, pass the window over the total.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, digits))


def share_within(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """(rows, cols, n, share): crosstab in long form, normalised by row."""
    counts = df.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(rows)), 6))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, filled, fill_rate): one pass over the rows, then one row per column.

    Filled is not null and, for text, not blank. An empty table has rate 0.
    """
    types = dict(df.dtypes)
    test = lambda c: (F.trim(F.col(f"`{c}`")) != "") if types[c] == "string" else F.col(f"`{c}`").isNotNull()
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(test(c), F.lit(False))).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)]))
    return one.select("n", rows.alias("r")).select("r.column", "n", "r.filled", F.round(F.col("r.filled") / F.greatest("n", F.lit(1)), 6).alias("fill_rate"))


def column_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, n, nulls, distinct): exact distinct counts come from unpivoted values, so that all
    columns share one shuffle and no column expands the rows of another."""
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.approx_count_distinct(f"`{c}`").alias(f"d{i}"))])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]))
        return one.select("n", rows.alias("r")).select("r.column", "n", "r.nulls", "r.distinct")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct")
    )


def with_total(df: DataFrame, by: str, aggregates: Sequence[Column], label: str = "OVERALL", at_least: int = 0) -> DataFrame:
    """Aggregates by group plus one row over all rows, in one pass (rollup).

    Groups below at_least rows are hidden but count in the total. A NULL group stays NULL.
    """
    out = df.rollup(by).agg(F.grouping(by).alias("__total"), F.count(F.lit(1)).alias("n"), *aggregates)
    out = out.filter((F.col("__total") == 1) | (F.col("n") >= at_least))
    return out.withColumn(by, F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col(by).cast("string"))).drop("__total")


def crosstab_margins(df: DataFrame, rows: str, cols: str, values: Sequence[str], label: str = "Total") -> DataFrame:
    """Counts by rows and the given column values, with a Total row and column (cube)."""
    counts = df.rollup(rows).agg(F.grouping(rows).alias("__t"), *[F.count_if(F.col(cols) == v).alias(v) for v in values], F.count(F.lit(1)).alias(label))
    return counts.withColumn(rows, F.when(F.col("__t") == 1, F.lit(label)).otherwise(F.col(rows).cast("string"))).drop("__t")


def _cuts(value: str, parts: int) -> Column:
    """Values that cut the rows into about equal parts, from a bounded summary combined on the map side."""
    return F.percentile_approx(value, [(i + 1) / parts for i in range(parts - 1)], 20 * parts)


def _part(value: Column, cuts: Column) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(cuts, lambda c: c < value))


def _placed(df: DataFrame, by: Sequence[str], value: str, parts: int = 64) -> DataFrame:
    """(by, __v, __c, __n, __upto): distinct values with their frequency, the rows of the group and those up to the value.

    Rows shrink to counts per distinct value. Groups are cut into ranges of about equal numbers of rows, wherever
    the values lie, and only inside a range are values put in order, so a hot group is ordered by many tasks. NULL
    values don't count; by names at least one column.
    """
    filled = df.filter(F.col(value).isNotNull())
    counts = filled.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    span = filled.groupBy(*by).agg(_cuts(value, parts).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    where = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in by]
    keyed = span.select(*[F.col(k).alias(f"__s_{k}") for k in by], "__cuts", "__n")
    rows = counts.join(keyed, where).select(*by, "__v", "__c", "__n", _part(F.col("__v"), F.col("__cuts")).alias("__b"))
    sums = rows.groupBy(*by, "__b").agg(F.sum("__c").alias("__bc"))
    before = sums.withColumn("__before", F.sum("__bc").over(W.partitionBy(*by).orderBy("__b")) - F.col("__bc"))
    side = before.select(*[F.col(k).alias(f"__s_{k}") for k in by], F.col("__b").alias("__s_b"), "__before")
    placed = rows.join(side, where + [F.col("__b") == F.col("__s_b")])
    return placed.withColumn("__upto", F.col("__before") + F.sum("__c").over(W.partitionBy(*by, "__b").orderBy("__v"))).select(*by, "__v", "__c", "__n", "__upto")


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """Percentile by rank: element min(n, max(1, round(p / 100 * n + 0.5))) of the sorted values.

    Rounding is half to even; NULL values don't count; by names at least one column.
    """
    rank = lambda p: F.least(F.col("__n"), F.greatest(F.lit(1), F.bround(F.lit(p / 100.0) * F.col("__n") + 0.5, 0).cast("long")))
    return _placed(df, by, value).groupBy(*by).agg(*[F.min(F.when(F.col("__upto") >= rank(p), F.col("__v"))).alias(f"p{p:g}") for p in percents])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(by, one column per name): exact quantiles with linear interpolation, as a median at 0.5.

    Groups without a value give no row. by may be empty: one row, or none for an empty table.
    """
    keys = list(by) or ["__all"]
    rows = _placed(df if by else df.select(F.lit(1).alias("__all"), value), keys, value)
    at = {n: F.lit(s) * (F.col("__n") - 1) for n, s in shares.items()}
    reached = lambda k: F.min(F.when(F.col("__upto") >= k + 1, F.col("__v").cast("double")))
    ends = rows.groupBy(*keys).agg(
        *[c for n, x in at.items() for c in (reached(F.floor(x)).alias(f"__lo_{n}"), reached(F.ceil(x)).alias(f"__hi_{n}"), F.max(x - F.floor(x)).alias(f"__f_{n}"))]
    )
    return ends.select(*by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n) for n in shares])


def modal_value(df: DataFrame, by: Sequence[str], value: str, first_by: str | None = None) -> DataFrame:
    """(by, value, n): the most frequent value that isn't null.

    Ties go to the smallest value or, with first_by, an order of the rows, to the value seen first.
    """
    first = F.min(first_by) if first_by else F.lit(0)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), first.alias("__first"))
    top = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "__first", F.col(value).alias("v"))).alias("__t"))
    return top.select(*by, F.col("__t.v").alias(value), (-F.col("__t.neg")).alias("n"))


def threshold_metrics(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and precision, recall, F1 at each threshold in one pass of conditional sums.

    Predicted is score >= threshold. A metric with denominator 0 is NULL. Rows without score or
    label don't count.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    true = F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(t)
        aggs += [F.count_if(hit & true).alias(f"tp{i}"), F.count_if(hit & ~true).alias(f"fp{i}"), F.count_if(~hit & true).alias(f"fn{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, t in enumerate(thresholds)]))
    m = rows.agg(*aggs).select(each.alias("m")).select("m.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select(
        "threshold", "tp", "fp", "fn",
        F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def auc_ap(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, n_neg, auc, ap) with tied scores sharing their average rank.

    Rows shrink to counts per distinct score first. The running sums over scores are taken in two
    levels, within ranges of scores and over the ranges, so no single task holds all scores.
    """
    by_score = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    )
    run = running_totals(by_score, "s", ["p", "q"], descending=True)
    return run.agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.round(F.try_divide(F.sum(F.col("q").cast("double") * (F.col("p_upto") - F.col("p") / 2.0)), F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"),
        F.round(F.try_divide(F.sum(F.col("p").cast("double") * F.col("p_upto") / (F.col("p_upto") + F.col("q_upto"))), F.sum("p")), 6).alias("ap"),
    )


def auc_by(df: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc, ap) per group, for scores with few distinct values such as sums of level weights.

    Rows shrink to counts per group and score; only those are put in order. For scores that hardly repeat use ``auc_ap``.
    A group without matches, or without others, has no auc. With weight, a row counts as so many.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = lambda x: F.sum(F.when(x, one).otherwise(0))
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("__s"))
        .agg(rows(F.col(label) == 1).alias("p"), rows(F.col(label) != 1).alias("q"))
    )
    upto = W.partitionBy(*by).orderBy(F.desc("__s"))
    run = counts.withColumn("pu", F.sum("p").over(upto)).withColumn("qu", F.sum("q").over(upto))
    return run.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.round(F.try_divide(F.sum(F.col("q").cast("double") * (F.col("pu") - F.col("p") / 2.0)), F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"),
        F.round(F.try_divide(F.sum(F.col("p").cast("double") * F.col("pu") / (F.col("pu") + F.col("qu"))), F.sum("p")), 6).alias("ap"),
    )


def running_totals(df: DataFrame, order: str, values: Sequence[str], descending: bool = False, parts: int = 256) -> DataFrame:
    """df with <value>_upto, the inclusive running sum of each value over all rows in order.

    order must be unique and numeric. Rows are cut into ranges of about equal numbers of rows; each range keeps its own
    running sum, and the sums of the ranges before it (at most ``parts`` rows) are added.
    """
    cuts = df.agg(_cuts(order, parts).alias("c")).select("c").scalar()
    none = F.array().cast(f"array<{dict(df.dtypes)[order]}>")
    cut = df.withColumn("__cuts", cuts).withColumn("__b", _part(F.col(order), F.coalesce("__cuts", none))).drop("__cuts")
    o, b = (F.desc(order), F.desc("__b")) if descending else (F.asc(order), F.asc("__b"))
    sums = cut.groupBy("__b").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = sums.select("__b", *[(F.sum(f"__{v}").over(W.partitionBy(F.lit(0)).orderBy(b)) - F.col(f"__{v}")).alias(f"__{v}") for v in values])
    inside = cut.select("*", *[F.sum(v).over(W.partitionBy("__b").orderBy(o)).alias(f"{v}_upto") for v in values])
    joined = inside.join(F.broadcast(before), "__b")  # at most `parts` rows
    return joined.select(*df.columns, *[(F.col(f"{v}_upto") + F.col(f"__{v}")).alias(f"{v}_upto") for v in values])


def anchored_totals(df: DataFrame, by: Sequence[str], amount: str, anchor: Column, floor: float, digits: int = 2) -> DataFrame:
    """Group total of amount against the charge on the group's anchor rows, with a minimum.

    Adds group_total, expected (the larger of total and floor) and variance on anchor rows; NULL
    keys form a group of their own. Totals are aggregated first, then joined back to the anchors,
    so the rows of a large group never meet in one task.
    """
    totals = df.groupBy(*by).agg(F.sum(amount).alias("group_total"))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by]
    rows = df.filter(anchor).alias("a").join(totals.alias("t"), keys)
    expected = F.greatest(F.col("t.group_total"), F.lit(floor))
    return rows.select("a.*", F.bround(F.col("t.group_total"), digits).alias("group_total"), F.bround(expected, digits).alias("expected"), F.bround(F.col(f"a.{amount}") - expected, digits).alias("variance"))


def field_agreement(pairs: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(field, comparable, agreeing, rate, top_shared): agreement of paired fields, unpivoted.

    Rates leave out rows with a side missing. top_shared is the value most often shared, the
    smallest among equals.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(a).cast("string").alias("l"), F.col(b).cast("string").alias("r")) for f, (a, b) in fields.items()]))
    rows = pairs.select(cells.alias("c")).select("c.*").filter("l is not null and r is not null")
    rate = rows.groupBy("field").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("l") == F.col("r")).alias("agreeing"))
    top = modal_value(rows.filter("l = r"), ["field"], "l").select("field", F.col("l").alias("top_shared"))
    return rate.join(F.broadcast(top), "field", "left").select("field", "comparable", "agreeing", F.round(F.col("agreeing") / F.col("comparable"), 6).alias("rate"), "top_shared")
