import random

from weftline.operators import graph
from weftline.runtime import Stage


def union_find(edges):
    up = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return sorted((x, top(x)) for x in up)


def shapes():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    noise = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    ids = list(range(3000, 3200))
    rng.shuffle(ids)
    return {"chain": chain, "star": star, "noise": [e for e in noise if e[0] != e[1]], "shuffled": list(zip(ids, ids[1:]))}


def test_components(spark):
    edges = [e for s in shapes().values() for e in s]
    df = graph.edge_list(spark.createDataFrame(edges, "l long, r long"), "l", "r")
    assert sorted(map(tuple, graph.components(df, Stage(spark, "t")).collect())) == union_find(edges)


def test_no_edges(spark):
    df = graph.edge_list(spark.createDataFrame([(1, 1), (None, 2)], "l long, r long"), "l", "r")
    assert graph.components(df, Stage(spark, "t")).count() == 0


def skew_split(spark, frame):
    """The final plan of frame() under low limits for skew, with wide joins only."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        df = frame()
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def star(spark, n=60_000):
    return spark.range(1, n, 1, 8).selectExpr("'P000000000' as src", "format_string('P%09d', id) as dst")


def test_a_hub_is_split_in_climbing_and_contracting(spark):
    stage = Stage(spark, "t")
    edges = stage.write(star(spark).selectExpr("src as a", "dst as b"), "edges")
    tree = stage.write(graph._hooks(edges).repartition(8), "hooks")
    assert "skew=true" in skew_split(spark, lambda: graph._climb(tree))
    hub = stage.write(spark.sql("select 'P000000000' as v, 'A' as parent"), "hub")
    assert "skew=true" in skew_split(spark, lambda: graph._contract(edges, hub))


def test_hub_with_the_largest_id(spark):
    edges = [(i, 500) for i in range(1, 300)]
    df = graph.edge_list(spark.createDataFrame(edges, "l long, r long"), "l", "r")
    assert {r.component for r in graph.components(df, Stage(spark, "t")).collect()} == {1}
