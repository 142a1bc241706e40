"""Operators that split hot keys give what they give unsplit; hand-computed quantiles."""

import itertools
import random

from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.operators import aggregates, joins, linkage, windows


def test_row_numbers_of_a_hot_key(spark):
    rng = random.Random(4)
    orders = rng.sample(range(10_000), 700)
    data = [("hot" if i % 3 else f"k{i % 20}", o) for i, o in enumerate(orders)] + [(None, 5), (None, 3)]
    df = spark.createDataFrame(data, "k string, o long")
    want = sorted((k, o, 1 + sum(k2 == k and o2 < o for k2, o2 in data)) for k, o in data if k)
    for hot_rows in (50, 10**6):
        got = windows.row_numbers(df, "k", "o", "n", hot_rows)
        assert sorted(tuple(r) for r in got.filter("k is not null").collect()) == want
        assert sorted(r.n for r in got.filter("k is null").collect()) == [1, 2]


def test_pairs_of_a_hot_block(spark):
    data = [(i, "hot" if i % 4 else "b", i % 7) for i in range(60)] + [(99, None, 1), (98, None, 1)]
    df = spark.createDataFrame(data, "id long, block string, x long")
    want = sorted((b, i, x, j, y) for (i, b, x), (j, c, y) in itertools.combinations(data, 2) if b and b == c and i < j)
    for part_rows in (5, 2000):
        assert sorted(tuple(r) for r in joins.pairs_within(df, ["block"], part_rows).select("block", "id_1", "x_1", "id_2", "x_2").collect()) == want


def test_quantiles_with_an_outlier_and_ties(spark):
    values = [1.0] * 5 + [2.0, 3.0, 4.0, None, 1e12]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", None), (None, 7.0)], "g string, v double")
    got = {r.g: (r.m, r.p) for r in aggregates.quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.75}).collect()}
    assert got == {"g": (1.0, 3.0), None: (7.0, 7.0)}
    assert rows(aggregates.quantiles(df.filter("g = 'h'"), [], "v", {"m": 0.5})) == []
    assert rows(aggregates.nearest_rank(df, ["g"], "v", [50]).filter("g = 'g'")) == [("g", 1.0)]


def test_majority_ties(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", "y", 4), ("a", "x", 3), ("b", None, 1)], "g string, v string, o int")
    assert rows(aggregates.modal_value(df, ["g"], "v")) == [("a", "x", 2)]
    assert rows(aggregates.modal_value(df, ["g"], "v", "o")) == [("a", "y", 2)]


def test_random_pairs_are_about_half_the_rows_and_no_loops(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    got = joins.random_pairs(df, "id", 2000).collect()
    assert 700 < len(got) < 1300 and all(r.id_1 < r.id_2 for r in got)
    assert got == joins.random_pairs(df, "id", 2000).collect()


def test_level_shares_and_prior(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (3,)], "f int")
    assert linkage.level_shares(df, ["f"]) == {"f": [1.5 / 6, 2.5 / 6, 0.5 / 6, 1.5 / 6]}
    assert linkage.pair_prior(45, 10) == 0.5 and linkage.pair_prior(0, 10) == 1e-6 and linkage.pair_prior(3, 1) == 1e-6


def test_name_match(spark):
    df = spark.createDataFrame([("Ana Maria", "Anna Marya"), ("Bo", "Li"), (" ", "x"), (None, "x")], "a string, b string")
    got = [(round(r.name_score, 3), r.name_good) for r in linkage.with_name_match(df, "a", "b", 0.8).collect()]
    assert got == [(round((6 / 7 + 0.8) / 2, 3), True), (0.0, False), (0.0, False), (0.0, False)]


def test_rated(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    card = spark.createDataFrame([("a", 2.0), (None, 9.0)], "ck string, rate double")
    assert rows(joins.rated(left, card, "k", "ck")) == [(1, "a", 2.0, False), (2, None, None, True), (3, "z", None, True)]


def test_blocked_negatives_unfold_lists_instead_of_joining_pairs(spark):
    data = [(i, "xyz"[i % 3] if i % 11 else None, "ab"[i % 2] if i % 13 else None) for i in range(120)] + [(None, "x", "a")]
    df = spark.createDataFrame(data, "k int, grp string, b string")
    known = [x for x in data if None not in x]
    want = sorted((x[0], y[0], x[2]) for x in known for y in known if x[0] < y[0] and x[1] != y[1] and x[2] == y[2])
    for part_rows in (3, 2000):
        got = joins.blocked_negatives(df, "k", "grp", F.col("b"), part_rows)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "explode(__ids" in got._jdf.queryExecution().optimizedPlan().toString()


def test_split_ranks_only_the_ties_at_the_threshold(spark):
    df = spark.createDataFrame([(i % 40, i % 3) for i in range(1200)], "k int, label int")
    split = windows.stratified_split(df, "k", "label", 0.75)
    assert sorted((r.label, r["count"]) for r in split.filter("split = 'train'").groupBy("label").count().collect()) == [(0, 300), (1, 300), (2, 300)]
    assert split.count() == 1200
    assert windows.stratified_split(df, "k", "label", 1.0).filter("split = 'train'").count() == 1200


def test_agreement_is_the_level_of_the_similarity(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé1-") for _ in range(rnd.choice([0, 1, 4, 5, 9, 10, 11, 15, 19, 20, 24, 40])))
    pairs = []
    for _ in range(1500):
        a = word()
        b = list(a)
        for _ in range(rnd.randrange(6)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["", "x", "é", "1"])
        pairs.append((a, rnd.choice(["".join(b), word(), a, None, " "])))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", linkage.agreement(F.col("a"), F.col("b")).alias("x"), linkage.level(linkage.similarity(F.col("a"), F.col("b"))).alias("y")).collect()
    assert [r for r in got if r.x != r.y] == [] and {r.x for r in got} == {0, 1, 2, 3}


def test_weighted_combinations_count_as_their_pairs(spark):
    """Models are fitted to few combinations with counts: weights, prior and curve are those of the pairs one by one."""
    each = spark.createDataFrame([(i % 4, int(i % 5 < 2), (i % 4) / 3) for i in range(200)], "f int, label int, s double")
    few = each.groupBy("f", "label", "s").agg(F.count(F.lit(1)).cast("double").alias("n"))
    assert rows(linkage.fit_weights(each, ["f"], "label")) == rows(linkage.fit_weights(few, ["f"], "label", weight="n"))
    assert rows(aggregates.auc_by(each.withColumn("m", F.lit(1)), ["m"], "s", "label")) == rows(aggregates.auc_by(few.withColumn("m", F.lit(1)), ["m"], "s", "label", "n"))
    assert few.select(linkage.log_prior(few, "label", "n")).first() == each.select(linkage.log_prior(each, "label")).first()
