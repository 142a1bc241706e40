"""Small cases of nulls, ties, rounding and lenient parsing."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.functions import expr
from weftline.operators import aggregates, joins, linkage, mapping, schema, text, windows


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("t,want", [("$1,234.50", "1234.50"), ("($5)", "-5.00"), ("12%", "0.12"), ("", ""), (None, ""), ("abc", ""), ("0", "0.00"), ("2.345", "2.34")])
def test_money(spark, t, want):
    assert one(spark, t, expr.money_text) == want


@pytest.mark.parametrize("t,want", [("Doe, Jane", ("Jane", "Doe")), ("JANE ANN DOE", ("Jane", "Doe")), ("jane", ("Jane", "")), ("", ("", "")), (None, ("", "")), ("Doe ,  Jane Ann", ("Jane", "Doe"))])
def test_names(spark, t, want):
    assert tuple(spark.createDataFrame([(t,)], "c string").select(*expr.split_name(F.col("c"))).first()) == want


@pytest.mark.parametrize("t,want", [("1 y/o 3 months", 1), ("18 months", 1), ("newborn", 0), ("45", 45), ("x", None), (None, None)])
def test_age(spark, t, want):
    assert one(spark, t, expr.age_years) == want


def test_band_flags_and_pattern_boundaries(spark):
    df = spark.createDataFrame([("pt on o2 lpm", 0.98), ("o2x", None), (None, 0.5)], "t string, s double")
    hit = expr.flags(F.col("t"), {"o2": r"\bo2\b"})["o2"]
    got = [tuple(r) for r in df.select(hit, expr.band(F.col("s"), [(0.98, "top"), (0.5, "mid")], "non")).collect()]
    assert got == [(1, "top"), (0, "non"), (0, "mid")]


def test_agree_and_pattern(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "l string, r string")
    a = expr.agree(F.col("l"), F.col("r"))
    assert [r[0] for r in df.select(a).collect()] == [1, 0, None]
    assert [r[0] for r in df.select(expr.pattern_string({"x": a == 1})).collect()] == ["x", "none", "none"]


def test_percentile_definitions(spark):
    df = spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4)], "g string, v double")
    assert tuple(aggregates.nearest_rank(df, ["g"], "v", [50, 99, 1]).first()) == ("g", 2.0, 4.0, 1.0)
    assert df.select(F.median("v")).first()[0] == 2.5


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0), (None, 1)], "s double, y int")
    assert aggregates.auc_ap(df, "s", "y").first().auc == 0.875
    assert aggregates.auc_ap(df.filter("y = 1"), "s", "y").first().auc is None


def test_running_totals_match_a_plain_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("s"), (F.col("id") % 5).alias("p"))
    got = {r.s: r.p_upto for r in aggregates.running_totals(df, "s", ["p"], parts=16).collect()}
    total, want = 0, {}
    for s, p in sorted((r.s, r.p) for r in df.collect()):
        total += p
        want[s] = total
    assert got == want


def test_best_match_wildcards(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "x")], "id int, p string, q string")
    rules = spark.createDataFrame([(10, None, None), (11, "a", None), (12, "a", "x"), (13, "a", "x")], "rid int, rp string, rq string")
    got = rows(joins.best_match(left, "id", rules, [("p", "rp"), ("q", "rq")], "rid").select("id", "rid", "match_score"))
    assert got == [(1, 12, 2), (2, 10, 0), (3, 10, 0)]
    none = joins.best_match(left, "id", rules.limit(0), [("p", "rp"), ("q", "rq")], "rid")
    assert {r.rid for r in none.collect()} == {None}


def test_blocking_null_keys_never_match(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "z"), (4, None, "z")], "id int, x string, y string")
    got = rows(joins.blocking_pairs(df, "id", {"x": [F.col("x")], "xy": [F.col("x"), F.col("y")], "y": [F.col("y")]}))
    assert got == [(1, 2, "x"), (3, 4, "y")]


def test_grid_join_meets_each_pair_once(spark):
    a = spark.range(37).select(F.col("id").alias("x"))
    b = spark.range(23).select(F.col("id").alias("y"))
    assert joins.grid_join(a, b, F.col("x") > F.col("y"), 3).count() == sum(x > y for x in range(37) for y in range(23))


def test_keep_first_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, o int, v int")
    assert rows(windows.keep_first(df, ["k"], ["o", "v"])) == [("a", 5, 2), ("b", None, 3)]


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    got = windows.stratified_split(df, "id", "y", 0.75).groupBy("y").agg(F.count_if(F.col("split") == "train").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.t == int(r.n * 0.75) for r in got)


def test_recovery_and_knee(spark):
    df = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, True, False, True, True, True])], "g string, s long, ok boolean")
    assert windows.recovery(df, "g", "s", "ok").first().recovered_slot == 3
    assert windows.knee(df, "g", "s", "s", "ok").first().knee == 1


def test_month_end(spark):
    df = spark.createDataFrame([("2024-01-31", "31/12/x")], "d string, e string")
    out = mapping.column_rules(df, {"due": ("date_plus_1m_mmddyyyy", "d"), "bad": ("date_mmddyyyy", "e"), "op": ("nonsense", "d")}).first()
    assert tuple(out) == ("02/29/2024", "", "")


def test_predicate_without_real_clause_matches_nothing(spark):
    df = spark.createDataFrame([("a",)], "c string")
    t = {"must": [("c", "eq", "v"), {"should": [("c", "eq", "w")]}], "must_not": [("c", "eq", "z")]}
    assert df.filter(text.predicate(t, {"v": None, "w": None, "z": F.lit("q")})).count() == 0
    assert df.filter(text.predicate(t, {"v": F.lit("a"), "w": None, "z": F.lit("q")})).count() == 1
    assert df.filter(text.predicate(t, {"v": F.lit("a"), "w": None}, prune=("must", "should", "must_not"))).count() == 1


def test_similarity_missing_and_levels(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), (None, "x")], "a string, b string")
    s = linkage.similarity(F.col("a"), F.col("b"))
    assert [round(r[0], 4) for r in df.select(s).collect()] == [0.6667, -1.0, -1.0]
    assert [r[0] for r in df.select(linkage.level(s)).collect()] == [3, 0, 0]


def test_em_separates_two_kinds_of_pairs(spark):
    data = [(1, 1)] * 60 + [(3, 3)] * 800 + [(1, 3)] * 50 + [(3, 1)] * 50 + [(2, 1)] * 20
    model = linkage.em_weights(spark.createDataFrame(data, "x int, y int"), ["x", "y"])
    assert model["m"]["x"][1] > model["u"]["x"][1] and 0.01 < model["prior"] < 0.2


def test_names_and_resolution():
    assert schema.canonical_names(["A b", "a-b", "", "Ünï"]) == ["a_b", "a_b_2", "column", "ünï"]
    assert schema.resolve(["doc.party_id", "DOB"], {"p": ["party_id"], "d": ["dob"], "x": ["ob"]}) == {"p": "doc.party_id", "d": "DOB", "x": None}


def test_enrich_reports_failures(spark):
    def call(row):
        if row["x"] == 2:
            raise RuntimeError("no")
        return {"y": row["x"] * 10}

    got = rows(mapping.enrich(spark.createDataFrame([(1,), (2,)], "x int"), ["x"], call, "y int", retries=1))
    assert got == [(1, 10, "ok", 1, None), (2, None, "failed", 1, "RuntimeError: no")]


def test_enrich_pauses_once_a_batch_and_attempt(spark):
    """Failed and wrong answers of many rows wait together: 2,000 of them took (0.1 + 0.2) s x 2,000 / workers before."""
    import time

    def call(row):
        if row["x"] % 3 == 0:
            raise RuntimeError("no")
        return {"y": row["x"] % 3}

    df = spark.range(3000).select(F.col("id").cast("int").alias("x")).coalesce(1)
    began = time.time()
    got = rows(mapping.enrich(df, ["x"], call, "y int", retries=3, workers=4, valid=lambda a: "two" if a["y"] == 2 else None))
    assert time.time() - began < 60
    want = {0: (None, "failed", 3, "RuntimeError: no"), 1: (1, "ok", 1, None), 2: (None, "invalid", 3, "two")}
    assert got == sorted([(x, *want[x % 3]) for x in range(3000)], key=repr)


def test_enrich_keeps_the_answer_of_a_later_attempt(spark):
    def call(row):
        seen[row["x"]] = seen.get(row["x"], 0) + 1
        if seen[row["x"]] < row["x"]:
            raise RuntimeError("not yet")
        return {"y": row["x"]}

    seen: dict[int, int] = {}
    got = rows(mapping.enrich(spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int").coalesce(1), ["x"], call, "y int", retries=3))
    assert got == [(1, 1, "ok", 1, None), (2, 2, "ok", 2, None), (3, 3, "ok", 3, None), (4, None, "failed", 3, "RuntimeError: not yet")]
