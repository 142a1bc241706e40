"""Graphs of matched pairs: components by hooking and contraction, cluster statistics, impact of merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import first_match
from weftline.operators.aggregates import quantiles
from weftline.runtime import Stage


def edge_list(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected edges (src < dst) without nulls and loops."""
    rows = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    return rows.select(F.least(left, right).alias("src"), F.greatest(left, right).alias("dst")).distinct()


def _hooks(edges: DataFrame) -> DataFrame:
    """(v, parent): each vertex that has a smaller neighbour with the smallest one."""
    return edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent"))


def _climb(tree: DataFrame) -> DataFrame:
    """tree with the parent's parent as parent; moved where there was one. A vertex without a row is a root."""
    above = tree.select(F.col("v").alias("__v"), F.col("parent").alias("__up"))
    joined = tree.select("v", "parent").join(above, F.col("parent") == F.col("__v"), "left")
    return joined.select("v", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("moved"))


def _contract(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct edges between the roots of both ends."""
    for end in ("a", "b"):
        to = tree.select(F.col("v").alias("__v"), F.col("parent").alias("__to"))
        edges = edges.join(to, F.col(end) == F.col("__v"), "left").withColumn(end, F.coalesce("__to", end)).drop("__v", "__to")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(id, component), component the smallest id: hooking to smaller neighbours and contraction.

    Each round every vertex hooks to its smallest neighbour if that is smaller than itself, which gives
    trees; climbing by doubling finds their roots, and edges move to the roots until none is left. A root
    that nobody hooked to has a smaller neighbour in the next round, so two rounds at least halve the
    roots of a component, whatever its shape. All steps are written tables, so both sides of every join on a vertex
    are shuffled and a hub is split by adaptive execution; hooks are combined before their shuffle.
    """
    live, left = stage.write_counting(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "edges", "true")
    rounds: list[DataFrame] = []
    while left:
        tree, moved = stage.write(_hooks(live), "hooks"), 1
        while moved:
            higher, moved = stage.write_counting(_climb(tree), "climbed", "moved")
            stage.drop(tree)
            tree = higher
        rounds.append(tree.select("v", "parent"))
        contracted, left = stage.write_counting(_contract(live, rounds[-1]), "edges", "true")
        stage.drop(live)
        live = contracted
    if not rounds:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds.pop()
    for tree in reversed(rounds):  # a vertex is hooked in one round only; its root may be in a later one
        above = labels.select(F.col("v").alias("__v"), F.col("parent").alias("__top"))
        moved_up = tree.join(above, F.col("parent") == F.col("__v"), "left").select("v", F.coalesce("__top", "parent").alias("parent"))
        labels = stage.write(moved_up.unionByName(labels), "labels")
    roots = labels.select(F.col("parent").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return labels.select(F.col("v").alias("id"), F.col("parent").alias("component")).unionByName(roots)


def cluster_stats(labels: DataFrame, giant: int = 30) -> DataFrame:
    """One row: clusters, members, largest, mean and 99th percentile size, giants."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    p99 = quantiles(sizes, [], "size", {"p": 0.99}).select(F.round("p", 6)).scalar()
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("members"), F.max("size").alias("largest"), F.round(F.avg("size"), 6).alias("mean_size"),
        F.count_if(F.col("size") >= giant).alias("giants"),
    ).select("clusters", "members", "largest", "mean_size", p99.alias("p99_size"), "giants")


def gain_category(gain: Column) -> Column:
    return first_match([(gain < -10, "large loss"), (gain < 0, "loss"), (gain <= 5, "small gain"), (gain <= 15, "gain"), (gain <= 30, "large gain")], "very large gain")


def net_gain(labels: DataFrame, membership: DataFrame, id_col: str, entity: str) -> DataFrame:
    """(component, size, dominant, held, gain, category): what merging each component adds.

    dominant is the existing entity with most members in the component (ties: smallest name); held
    how many it has there; gain the members it would win, less those it holds outside.
    """
    member = membership.select(F.col(id_col).alias("id"), F.col(entity).alias("entity")).filter("id is not null and entity is not null").distinct()
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = labels.join(member, "id").groupBy("component", "entity").agg(F.count(F.lit(1)).alias("held"))
    # most members first, then the smallest name: a minimum over (-held, name)
    top = inside.groupBy("component").agg(F.min(F.struct((-F.col("held")).alias("h"), F.col("entity").alias("e"))).alias("t"))
    total = member.groupBy("entity").agg(F.count(F.lit(1)).alias("total"))
    out = sizes.join(top.select("component", F.col("t.e").alias("dominant"), (-F.col("t.h")).alias("held")), "component", "left").join(total, F.col("dominant") == F.col("entity"), "left")
    gain = F.col("size") - F.coalesce("held", F.lit(0)) - (F.coalesce("total", F.lit(0)) - F.coalesce("held", F.lit(0)))
    return out.select("component", "size", "dominant", F.coalesce("held", F.lit(0)).alias("held"), gain.alias("gain"), gain_category(gain).alias("category"))


def threshold_sweep(scored: DataFrame, left: str, right: str, score: str, thresholds: list[float], stage: Stage) -> DataFrame:
    """cluster_stats at each threshold, from high to low. As the threshold falls components only
    merge, so each pass starts from the labels of the last and adds only the new edges."""
    out, labels, upper = None, None, None
    for t in sorted(thresholds, reverse=True):
        band = scored.filter(F.col(score) >= t) if upper is None else scored.filter((F.col(score) >= t) & (F.col(score) < upper))
        edges = edge_list(band, left, right)
        if labels is not None:
            edges = edges.union(labels.filter("id <> component").select(F.col("component").alias("src"), F.col("id").alias("dst"))).distinct()
        labels = stage.write(components(edges, stage), "labels")
        row = cluster_stats(labels).select(F.lit(float(t)).alias("threshold"), "*")
        out = row if out is None else out.union(row)
        upper = t
    return out
