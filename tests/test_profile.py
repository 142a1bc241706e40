import datetime as dt
import math

from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.operators import profile

TS = dt.datetime(2025, 3, 1, 4, 30)


def cells(spark, values, field="f", table="t"):
    data = [(table, i, load, TS, field, v) for i, (load, v) in enumerate(values)]
    return spark.createDataFrame(data, "src_table string, row_id long, load_id int, load_ts timestamp, field_name string, value string")




def test_forms_and_ties(spark):
    c = cells(spark, [(1, "A12"), (1, "B34"), (2, "12"), (2, "34"), (2, None), (2, "  ")])
    counts = profile.value_counts(c)
    modal = profile.modal_forms(counts, ["f"])
    assert rows(modal.select("modal_form", "n_modal")) == [("99", 2)]  # tie: the form that sorts first
    assert rows(profile.form_cases(c, modal).select("row_id")) == [(0,), (1,)]


def test_form_of_other_scripts(spark):
    df = spark.createDataFrame([("Ab1-é٣Ж",)], "t string")
    assert df.select(profile.form_of(F.col("t"))).first()[0] == "Aa9-a9A"


def test_dates(spark):
    c = cells(spark, [(1, x) for x in ("2024-02-29", "2023-02-29", "1899-12-31", "1900-01-01", "2025-03-01", "2025-03-02", "0000-01-01", "2024-13-01", "01/02/2024")])
    modal = profile.modal_forms(profile.value_counts(c), ["f"])
    assert [r[0] for r in rows(profile.date_range_cases(c, modal, "f", "1900-01-01").select("value"))] == ["0000-01-01", "1899-12-31", "2023-02-29", "2024-13-01", "2025-03-02"]


def loads(spark, values, **kw):
    counts = profile.value_counts(cells(spark, values), kw.get("free", ()))
    totals = profile.load_totals(counts)
    values = profile.by_value(counts, ["src_table", "field_name", "value", "filled"])
    return {(r.finding, r.load_id) for r in profile.load_findings(totals, profile.drift(values, totals), ["f"], ["f"]).collect()}


def test_limits_are_exact(spark):
    # load 1: 5 of 10 empty, load 2: none of 10; overall 0.25, both off by 0.25
    assert {("null_rate", 1), ("null_rate", 2)} <= loads(spark, [(1, None)] * 5 + [(1, "a")] * 5 + [(2, "a")] * 10)
    # off by exactly 0.2: no case
    assert not {x for x in loads(spark, [(1, None)] * 4 + [(1, "a")] * 6 + [(2, "a")] * 10) if x[0] == "null_rate"}


def test_mix_counts_absent_values(spark):
    got = loads(spark, [(1, "a")] * 10 + [(2, "b")] * 10 + [(3, "a")] * 5 + [(3, "b")] * 5)
    assert {x for x in got if x[0] == "mix"} == {("mix", 1), ("mix", 2)}


def test_free_text_goes_by_digest(spark):
    counts = profile.value_counts(cells(spark, [(1, "x" * 1000), (1, "x" * 1000), (1, "a\x01b")]), ["f"])
    got = counts.collect()
    assert {len(r.value) for r in got} == {64} and sum(r.n for r in got) == 3 and sum(r.control for r in got) == 1


def test_unreadable_and_wrapped(spark):
    df = spark.createDataFrame([(1, '{"a": 1.50}'), (2, "{"), (3, None), (4, '"{\\"a\\": \\"x\\"}"'), (5, "[1]"), (6, " {\"a\": {\"b\": 2}} ")], "id long, s string")
    got = rows(profile.json_fields(df, "s", ["a"], ["id"]))
    assert got == [(1, "read", "1.50"), (2, "unreadable", None), (3, "null", None), (4, "read", "x"), (5, "read", None), (6, "read", '{"b":2}')]


def test_all_fields_of_a_json_column_are_profiled(spark):
    texts = [
        (1, '{"a": "x", "names": [{"first": "Al"}, {"last": "B"}]}'), (1, '{"a": null, "names": {"first": "Cy"}}'), (1, "{"), (1, None),
        (2, '{"a": "y", "late": {"k.l": ["p", null, {"z": 1}]}}'), (2, "[1]"),
    ]
    df = spark.createDataFrame(texts, "load_id int, s string")
    counts = profile.with_absent(profile.json_counts(df, "t", "s")).withColumn("control", F.lit(None).cast("boolean"))
    got = {(r.field_name, r.load_id): (r.n_rows, r.n_filled, r.n_distinct, r.min_value, r.max_value, r.modal_form) for r in profile.profile(counts).collect()}
    none = (None, None)
    assert got == {
        ("a", 1): (2, 1, 1, "x", "x", "a"), ("a", 2): (2, 1, 1, "y", "y", "a"),
        ("names", 1): (2, 2, 2, *none, None), ("names", 2): (2, 0, 0, *none, None),
        ("names.first", 1): (3, 2, 2, "Al", "Cy", "Aa"), ("names.last", 1): (3, 1, 1, "B", "B", "A"),
        ("late", 1): (2, 0, 0, *none, None), ("late", 2): (2, 1, 1, *none, None),
        (r"late.k\.l", 2): (1, 1, 1, *none, None), (r"late.k\.l[]", 2): (2, 1, 1, "p", "p", "a"), (r"late.k\.l.z", 2): (1, 1, 1, "1", "1", "9"),
        ("$", 1): (2, 0, 0, *none, None), ("$", 2): (2, 1, 1, *none, None), ("$[]", 2): (1, 1, 1, "1", "1", "9"),
    }


def moved(spark, values):
    counts = profile.value_counts(cells(spark, values))
    return {r.load_id: r for r in profile.drift(profile.by_value(counts, ["src_table", "field_name", "value", "filled"]), profile.load_totals(counts)).collect()}


def psi_by_hand(values):
    loads, all_values = {load for load, _ in values}, [v for _, v in values if v and v.strip()]
    out = {}
    for load in loads:
        mine = [v for at, v in values if at == load and v and v.strip()]
        terms = []
        for v in set(all_values):
            p, q = (mine.count(v) + 0.5) / (len(mine) + 0.5), (all_values.count(v) + 0.5) / (len(all_values) + 0.5)
            terms.append((p - q) * math.log(p / q))
        out[load] = sum(terms)
    return out


def test_a_vanished_value_counts_in_psi_and_chi2(spark):
    got = moved(spark, [(1, "A")] * 50 + [(1, "B")] * 50 + [(2, "A")] * 100)
    # load 2: p(A) = 1, q(A) = 150.5 / 200.5, p(B) = 0.5 / 100.5, q(B) = 50.5 / 200.5
    assert abs(got[2].psi - ((1 - 150.5 / 200.5) * math.log(200.5 / 150.5) + (0.5 / 100.5 - 50.5 / 200.5) * math.log(0.5 / 100.5 / (50.5 / 200.5)))) < 1e-9
    assert got[2].psi > 1 and abs(got[2].chi2 - (25**2 / 75 + 25**2 / 25)) < 1e-9
    assert abs(got[1].chi2 - (25**2 / 75 + 25**2 / 25)) < 1e-9


def test_psi_by_hand(spark):
    values = [(load, "abcdefg"[(load * i * i + i) % (load + 3)]) for load in (1, 2, 3, 4) for i in range(40)] + [(1, None)] * 5 + [(5, " ")] * 3
    want, got = psi_by_hand(values), moved(spark, values)
    assert set(got) == {1, 2, 3, 4}
    for load, r in got.items():
        assert abs(r.psi - want[load]) < 1e-9
