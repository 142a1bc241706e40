"""Joins: two-sided lookups, pair construction, blocking, best match and set comparison.

Pairs are only built inside equal keys or on a grid of cells; there is no Cartesian product.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.tables import small
from weftline.operators.windows import row_numbers


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column renamed with a suffix, but those in keep."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else f"{c}{suffix}") for c in df.columns])


def two_sided(pairs: DataFrame, attributes: DataFrame, key: str, left: str, right: str, broadcast_rows: int = 0) -> DataFrame:
    """Left-join the attributes of both ends of each pair, as <column>_l and <column>_r.

    Attributes are first reduced to the ids that occur in pairs. Ids without attributes keep NULLs;
    an id with several attribute rows multiplies its pairs. Attributes of at most broadcast_rows rows are
    broadcast, with the same result.
    """
    ids = pairs.select(F.col(left).alias(key)).union(pairs.select(F.col(right).alias(key))).distinct()
    used = attributes.join(ids, key, "left_semi")
    used = small(used, broadcast_rows) if broadcast_rows else used
    a, b = suffixed(used, "_l"), suffixed(used, "_r")
    return pairs.join(a, F.col(left) == F.col(f"{key}_l"), "left").join(b, F.col(right) == F.col(f"{key}_r"), "left").drop(f"{key}_l", f"{key}_r")


def within_group_pairs(df: DataFrame, group: str, id_col: str, size: tuple[int, int] = (2, 10)) -> DataFrame:
    """(group, id_1, id_2), id_1 < id_2: all unordered pairs inside groups of a size in range.

    The size range is the operator's own limit; larger groups are left to star_pairs. NULL groups
    form no pairs.
    """
    rows = df.select(group, id_col).distinct()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n").between(*size)).select(group)
    kept = rows.join(sizes, group, "left_semi")
    a, b = kept.select(group, F.col(id_col).alias("id_1")), kept.select(group, F.col(id_col).alias("id_2"))
    return a.join(b, group).filter("id_1 < id_2")


def star_pairs(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, anchor, member): each member with the smallest id of its group; linear in rows."""
    rows = df.select(group, id_col).filter(f"`{group}` is not null").distinct()
    anchors = rows.groupBy(group).agg(F.min(id_col).alias("anchor"))
    return rows.join(anchors, group).filter(F.col(id_col) != F.col("anchor")).select(group, "anchor", F.col(id_col).alias("member"))


def grid_join(left: DataFrame, right: DataFrame, condition: Column, cells: int = 4) -> DataFrame:
    """Join on any condition as an equi-join over a grid of cells x cells.

    Each left row goes to a row of the grid by hash and is copied to its cells, each right row to a
    column; every pair meets in exactly one cell, and cells are equal in size whatever the keys.
    Work is the product of the sides, as any such condition implies: reduce them first.
    """
    side = F.sequence(F.lit(0), F.lit(cells - 1))
    spread = lambda df: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(cells)).cast("int")
    a = left.withColumn("__i", spread(left)).withColumn("__j", F.explode(side))
    b = right.withColumn("__j", spread(right)).withColumn("__i", F.explode(side))
    return a.join(b, ["__i", "__j"]).filter(condition).drop("__i", "__j")


def negatives(df: DataFrame, id_col: str, group: str, cells: int = 4) -> DataFrame:
    """(id_1, id_2) of different groups, id_1 < id_2: use on a sample."""
    rows = df.select(F.col(id_col).alias("id"), F.col(group).alias("g"))
    a, b = suffixed(rows, "_1"), suffixed(rows, "_2")
    return grid_join(a, b, (F.col("id_1") < F.col("id_2")) & (F.col("g_1") != F.col("g_2")), cells).select("id_1", "id_2")


#: Rows of one block that a part of it holds.
PART_ROWS = 2_000


def pairs_within(rows: DataFrame, keys: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, id_1, id_2, other columns _1 and _2), id_1 < id_2: all pairs of rows (id, keys, ...) that share the keys.

    Null keys pair with nothing. A block with more than part_rows rows is split: its left rows are dealt to parts by a hash
    of their id, its right rows are copied to each, so no task holds the pairs of a hot block; the pairs are the same.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > part_rows)
    split = rows.join(small(sizes), list(keys), "left").withColumn("__parts", F.coalesce(F.ceil(F.col("__n") / part_rows), F.lit(1)).cast("int")).drop("__n")
    keep = [*keys, "__part"]
    a = suffixed(split.withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__parts"), "_1", keep)
    b = suffixed(split.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts"), "_2", keep)
    return a.join(b, keep).filter("id_1 < id_2").drop("__part")


def random_pairs(df: DataFrame, id_col: str, n_rows: int, seed: int = 1) -> DataFrame:
    """(columns _1 and _2) of about n_rows / 2 pairs of different rows, drawn alike on every run: rows whose two hashes meet."""
    slots = F.lit(max(n_rows, 1))
    at = lambda s: F.pmod(F.xxhash64(F.lit(seed + s), F.col(id_col)), slots)
    a, b = suffixed(df.withColumn("__slot", at(0)), "_1", ["__slot"]), suffixed(df.withColumn("__slot", at(1)), "_2", ["__slot"])
    return a.join(b, "__slot").filter(F.col(f"{id_col}_1") < F.col(f"{id_col}_2")).drop("__slot")


def blocked_negatives(df: DataFrame, id_col: str, group: str, block: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """(id_1, id_2, block): pairs of different groups that share a block key.

    The rows of a block travel as arrays of at most about part_rows ids per group, which each row of the block unfolds: the pairs are far
    more than the rows, and only they are made one by one. Arrays that hold no larger id, and the row's own group, aren't unfolded.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(group).alias("g"), block.alias("block")).filter("id is not null and g is not null and block is not null")
    sizes = rows.groupBy("block", "g").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > part_rows)
    cut = rows.join(small(sizes), ["block", "g"], "left").withColumn("__part", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("__n") / part_rows), F.lit(1))))
    lists = cut.groupBy("block", "g", "__part").agg(F.collect_list("id").alias("__ids"), F.max("id").alias("__last"))
    a = rows.select(F.col("block"), F.col("id").alias("id_1"), F.col("g").alias("g_1"))
    b = lists.select("block", F.col("g").alias("g_2"), "__ids", "__last")
    found = a.join(b, "block").filter("g_1 <> g_2 and id_1 < __last")
    return found.select("id_1", F.explode("__ids").alias("id_2"), "block").filter("id_1 < id_2")


def blocking_pairs(df: DataFrame, id_col: str, rules: Mapping[str, Sequence[Column]]) -> DataFrame:
    """(id_1, id_2, rules): candidate pairs of the union of blocking rules, each once.

    A rule equates all its keys; a null key never matches. rules lists, in order, the rules that
    found the pair. Keys are hashed to one column so that all rules share one join.
    """
    keys = [
        F.struct(F.lit(i).alias("rule"), F.when(sum((k.isNull().cast("int") for k in ks), F.lit(0)) == 0, F.concat_ws("\x1f", *[k.cast("string") for k in ks])).alias("key"))
        for i, ks in enumerate(rules.values())
    ]
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(*keys)).alias("k")).select("id", "k.*").filter("key is not null")
    pairs = pairs_within(rows, ["rule", "key"]).groupBy("id_1", "id_2").agg(F.sort_array(F.collect_set("rule")).alias("r"))
    names = F.array(*map(F.lit, rules))
    return pairs.select("id_1", "id_2", F.array_join(F.transform("r", lambda i: F.get(names, i)), "+").alias("rules"))


def best_match(left: DataFrame, left_id: str, rules: DataFrame, keys: Sequence[tuple[str, str]], rule_id: str) -> DataFrame:
    """Best rule per row, where a null rule key is a wildcard: most keys matched, then smallest id.

    Rows without a rule keep NULLs. Instead of comparing each row with each rule, each pattern of
    wildcards present in the rules becomes one equi-join key; a row probes each pattern once.
    """
    shape = lambda cols: F.concat_ws("", *[F.when(F.col(r).isNull(), F.lit("0")).otherwise(F.lit("1")) for r in cols])
    rule_cols = [r for _, r in keys]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    ruled = rules.withColumn("__shape", shape(rule_cols)).withColumn(
        "__key", F.concat_ws("\x1f", *[F.when(F.col(r).isNotNull(), text(r)).otherwise(F.lit("*")) for r in rule_cols])
    )
    one = ruled.groupBy("__shape", "__key").agg(F.min(rule_id).alias("__rule"))
    shapes = [s.__getitem__("__shape") for s in one.select("__shape").distinct().collect()]  # at most 2 ** len(keys)
    probes = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("__shape"), F.lit(s.count("1")).alias("__score"),
                    F.concat_ws("\x1f", *[text(l) if bit == "1" else F.lit("*") for bit, (l, _) in zip(s, keys)]).alias("__key"),
                )
                for s in shapes
            ]
        )
    ) if shapes else None
    if probes is None:
        return left.withColumn(rule_id, F.lit(None).cast(dict(rules.dtypes)[rule_id])).withColumn("match_score", F.lit(None).cast("int"))
    hits = left.select(left_id, probes.alias("p")).select(left_id, "p.*").join(one, ["__shape", "__key"])
    best = hits.groupBy(left_id).agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__rule").alias("r"))).alias("b"))
    return left.join(best.select(left_id, F.col("b.r").alias(rule_id), (-F.col("b.s")).cast("int").alias("match_score")), left_id, "left")


def compare_full(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, <value>_exp, <value>_act, status): full outer comparison by key.

    status: equal, differs, missing (no actual row) or extra (no expected row); nulls are equal.
    """
    e = expected.select(*keys, F.col(value).alias(f"{value}_exp"), F.lit(1).alias("__e"))
    a = actual.select(*keys, F.col(value).alias(f"{value}_act"), F.lit(1).alias("__a"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col(f"{value}_exp").eqNullSafe(F.col(f"{value}_act")), "equal").otherwise("differs")
    return e.join(a, list(keys), "full_outer").withColumn("status", status).drop("__e", "__a")


def lookup_first(df: DataFrame, key: str, value: str, order: str, last: bool = False) -> DataFrame:
    """(key, value): one value per key, the first (or last) by a unique order; null keys dropped."""
    pick = F.max_by if last else F.min_by
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(value, order).alias(value))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def count_aligned(rows: DataFrame, targets: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """Rows of each key repeated in a cycle, or cut, to the key's target count.

    Keys without rows, or without a target, give nothing. position counts from 1. order is numeric and unique within a key.
    """
    numbered = row_numbers(rows, key, order, "__i")
    sized = numbered.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__m")), key).join(targets.select(key, target), key)
    # row i serves positions i, i + m, i + 2m, ... up to the target
    copies = F.when(F.col(target) >= F.col("__i"), F.sequence(F.col("__i").cast("long"), F.col(target).cast("long"), F.col("__m").cast("long")))
    return sized.withColumn("position", F.explode(copies)).drop("__i", "__m", target)


def rated(rows: DataFrame, card: DataFrame, key: str, card_key: str) -> DataFrame:
    """rows with the columns of a card of rates (one row per key) and no_rate, true where the card lacks the key.

    Every row stays, one with a null key too. A card that is small is broadcast; a card row with a null key serves nothing.
    """
    marked = small(card.filter(F.col(card_key).isNotNull()).withColumn("__rated", F.lit(True)))
    return rows.join(marked, F.col(key) == F.col(card_key), "left").withColumn("no_rate", F.col("__rated").isNull()).drop("__rated", card_key)


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, those of keys that occur in new replaced by the rows of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, n): composite keys on one side or both, with how often each occurs."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    x, y = (d.select(*[F.col(k).alias(f"{k}{s}") for k in keys], c) for d, s, c in ((x, "_a", "na"), (y, "_b", "nb")))
    on = [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys]
    side = F.when(F.col("nb").isNull(), "only_a").when(F.col("na").isNull(), "only_b").otherwise("both")
    return x.join(y, on, "full_outer").select(
        *[F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in keys], side.alias("side"), F.coalesce("na", F.lit(0)).alias("n_a"), F.coalesce("nb", F.lit(0)).alias("n_b")
    )


def overlap(a: Column, b: Column) -> Column:
    """Shared / (shared + only a + only b) of two arrays as sets; NULL if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared, F.size(F.array_union(a, b)))
