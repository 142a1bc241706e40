"""Groups from pairwise matches: Boruvka hooking with pointer doubling.

Each round, every component picks its smallest outgoing edge. Edges are ordered by (smaller end,
larger end), so the pick is the edge to the smallest neighbour, and the picks of one round form
trees whose only cycles are pairs that picked the same edge; the smaller of such a pair is the
root. Pointer doubling collapses each tree to its root, edges are relabelled to roots, loops and
repeats go, and the next round runs on the contracted graph until no edge is left.

The number of components at least halves per round, so n vertices take at most log2(n) rounds,
each with at most log2(depth) doublings, whatever the shape (chains, stars, giant components).
The smallest vertex of a component is always the smaller end of a mutual pick, so it is a root in
every round: the final label is the smallest id of the component without a further pass.

Only (vertex, label) rows move. The labels of each round cover only the components alive in it,
so composing them backwards costs a geometric series. Tables are cut at a written file per step;
a lost executor costs the tasks of one step. Picks are minima combined before the shuffle, and
mutual ones are found by edge. Every join on a vertex is between two written tables, so both
sides are shuffled for it, and as the label side is unique, adaptive execution splits a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.tables import trimmed
from weftline.runtime import Stage


def clean_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected edges (a, b), a < b: ids in capitals without white space around them.

    Pairs with a side null or blank and pairs of an id with itself are no edges.
    """
    x, y = F.upper(trimmed(F.col(left).cast("string"))), F.upper(trimmed(F.col(right).cast("string")))
    ends = pairs.select(x.alias("x"), y.alias("y")).filter("x <> '' and y <> '' and x <> y")
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _pick(edges: DataFrame) -> DataFrame:
    """(v, parent): each vertex with its smallest neighbour, combined before the shuffle."""
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n"))))
    return edges.select(both.alias("e")).groupBy("e.v").agg(F.min("e.n").alias("parent"))


def _root_pairs(picks: DataFrame) -> DataFrame:
    """The smaller end of each mutual pick becomes a root (its own parent).

    A pick is mutual if both ends picked the same edge. Picks are grouped by edge, not joined by vertex: an
    edge is picked at most twice, so no group is large, however many vertices picked one hub.
    """
    edges = picks.groupBy(F.least("v", "parent").alias("lo"), F.greatest("v", "parent").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    row = lambda v, parent: F.struct(v.alias("v"), parent.alias("parent"))
    lo, hi = F.col("lo"), F.col("hi")
    once = row(F.col("v"), F.when(F.col("v") == lo, hi).otherwise(lo))
    return edges.select(F.explode(F.when(F.col("n") == 2, F.array(row(lo, lo), row(hi, lo))).otherwise(F.array(once))).alias("r")).select("r.*")


def _double(tree: DataFrame) -> DataFrame:
    up = tree.select(F.col("v").alias("__v"), F.col("parent").alias("__up"))
    return tree.join(up, F.col("parent") == F.col("__v")).select("v", F.col("__up").alias("parent"), (F.col("__up") != F.col("parent")).alias("moved"))


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    ra = roots.select(F.col("v").alias("a"), F.col("parent").alias("ra"))
    rb = roots.select(F.col("v").alias("b"), F.col("parent").alias("rb"))
    moved = edges.join(ra, "a").join(rb, "b").filter("ra <> rb")
    return moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is its smallest vertex.

    edges: distinct (a, b) with a < b, as from clean_edges. No edges give no rows.
    """
    live, n_edges = stage.write_counting(edges, "edges", "true")
    rounds: list[DataFrame] = []
    while n_edges:
        tree, moved = stage.write(_root_pairs(_pick(live)), "picks"), 1
        while moved:
            collapsed, moved = stage.write_counting(_double(tree), "doubled", "moved")
            stage.drop(tree)
            tree = collapsed
        rounds.append(tree.select("v", "parent"))
        contracted, n_edges = stage.write_counting(_relabel(live, rounds[-1]), "edges", "true")
        stage.drop(live)
        live = contracted
    if not rounds:
        return live.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:
        above = labels.select(F.col("v").alias("__v"), F.col("parent").alias("__top"))
        labels = rounds.pop().join(above, F.col("parent") == F.col("__v"), "left").select("v", F.coalesce("__top", "parent").alias("parent"))
        if rounds:
            labels = stage.write(labels, "labels")
    return labels.select(F.col("v").alias("vertex"), F.col("parent").alias("component"))
