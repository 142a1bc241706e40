import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_graph import shapes, union_find
from weftline.llm import components
from weftline.runtime import Stage


def run(spark, edges):
    df = components.clean_edges(spark.createDataFrame(edges, "l string, r string"), "l", "r")
    return rows(components.components(df, Stage(spark, "t")))


def test_shapes(spark):
    edges = [(f"{a:06d}", f"{b:06d}") for s in shapes().values() for a, b in s]
    rng = random.Random(1)
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    assert run(spark, edges) == union_find(edges)


def test_dirty_ids(spark):
    assert run(spark, [(" p2", "P1\t"), ("P2", "p1"), ("P3", None), (None, None), ("", "P4"), ("P5", "p5 "), ("P2", " p9")]) == [("P1", "P1"), ("P2", "P1"), ("P9", "P1")]


def test_no_edges(spark):
    assert run(spark, [("A", "A"), (None, "B")]) == []


def test_hub_with_a_third_of_all_edges(spark):
    edges = [("HUB", f"A{i:05d}") for i in range(3000)] + [(f"B{i:05d}", f"B{i + 1:05d}") for i in range(0, 6000, 2)]
    assert run(spark, edges) == union_find(edges)


def test_a_hub_is_split(spark):
    from tests.test_graph import skew_split, star
    from weftline.runtime import Stage

    stage = Stage(spark, "t")
    edges = stage.write(star(spark).selectExpr("src as a", "dst as b"), "edges")
    tree = stage.write(components._root_pairs(components._pick(edges)).repartition(8), "picks")
    assert "skew=true" in skew_split(spark, lambda: components._double(tree))
    hub = stage.write(spark.sql("select 'P000000000' as v, 'A' as parent").union(tree.select("v", F.col("v").alias("parent")).filter("v > 'P000000000'")), "hub")
    assert "skew=true" in skew_split(spark, lambda: components._relabel(edges, hub))
    assert "Join" not in components._root_pairs(components._pick(edges))._jdf.queryExecution().executedPlan().toString()
