from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.operators import schema


def test_a_field_in_one_row_of_many_is_found(spark):
    df = spark.range(10_000).select(F.when(F.col("id") == 7777, F.lit('{"k": 1, "rare": {"deep": "x"}}')).otherwise(F.lit('{"k": 2}')).alias("s"))
    flat = schema.flatten(schema.parse_json(df, "s", schema.infer_json_ddl(df, "s")).drop("s"))
    assert flat.columns == ["doc_k", "doc_rare_deep"]
    assert rows(flat.filter("doc_rare_deep is not null")) == [(1, "x")]


def test_mixed_null_and_odd_names(spark):
    texts = ['{"a": 1, "OBJECT": {"VOID x": null, "é`": [1.5]}, "m": {}}', '{"a": "t", "m": {}}', None, "  ", "{", "[1]", '"x"', '{"a": 1, "a": 2, "b": 3}']
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = schema.flatten(schema.parse_json(df, "s", schema.infer_json_ddl(df, "s")).drop("s"))
    assert rows(got.filter("doc_a is not null").select("doc_a", "doc_m")) == [("1", "{}"), ("t", "{}")]
    assert sorted(got.columns) == sorted(["doc_a", "doc_OBJECT_VOID x", "doc_OBJECT_é`", "doc_m"])


def test_no_objects(spark):
    df = spark.createDataFrame([(None,), ("7",)], "s string")
    assert schema.infer_json_ddl(df, "s") == "STRUCT<>" == schema.infer_json_ddl(df.limit(0), "s")


def test_flatten_names_and_depth(spark):
    df = spark.createDataFrame([((1, (2, 3)), 4, [5])], "a struct<b: int, c: struct<d: int, e: int>>, a_b int, l array<int>")
    assert rows(schema.flatten(df)) == [(1, 2, 3, 4, [5])]
    assert schema.flatten(df).columns == ["a_b", "a_c_d", "a_c_e", "a_b_2", "l"]
    assert schema.flatten(df, 1).columns == ["a_b", "a_c", "a_b_2", "l"]


def test_only_the_arrays_on_the_way_are_exploded(spark):
    t = "id int, m struct<run: string, c: array<struct<who: string, s: array<struct<score: double>>>>>, names array<string>"
    df = spark.createDataFrame([(1, ("r", [("p", [(0.5,), (0.7,)]), ("q", [])]), ["x", "y"]), (2, None, None)], t)
    out = schema.explode_for(df, "score")
    assert sorted(out.columns) == ["id", "m_c_s_score", "m_c_who", "m_run", "names"]
    got = rows(out.select("id", "m_run", "m_c_who", "m_c_s_score", "names"))
    assert got == sorted([(1, "r", "p", 0.5, ["x", "y"]), (1, "r", "p", 0.7, ["x", "y"]), (1, "r", "q", None, ["x", "y"]), (2, None, None, None, None)], key=repr)


def test_explode_without_such_a_field_or_array(spark):
    df = spark.createDataFrame([(1, (2,), [[3, 4], []])], "id int, s struct<score: int>, n array<array<int>>")
    assert rows(schema.explode_for(df, "missing")) == [(1, 2, [[3, 4], []])] == rows(schema.explode_for(df, "score"))


def test_names_and_alternatives():
    assert schema.canonical_names(["A b", "a-B", "", "--"]) == ["a_b", "a_b_2", "column", "column_2"]
    kinds = {"long": ["id", "x", "y"], "short": ["id"]}
    assert schema.first_schema(["id", "x", "y", "z"], kinds) == "long" and schema.first_schema(["id"], kinds) == "short" and schema.first_schema([], kinds) is None
