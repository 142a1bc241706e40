import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftline.functions import expr
from weftline.operators import mapping, text
from weftline.sources import io


def test_blocks_walk_back_over_lines_that_go_on(spark):
    t = "query a\nWARN x\nERROR 1\nother\nERROR 2\nquery b\nWARN y\nWARN z\nWARN w\nERROR 3\nquery c\nERROR 4\nend"
    df = spark.createDataFrame([(1, t), (2, "nothing here"), (3, None), (4, ""), (5, "WARN a\r\nERROR")], "id int, t string")
    got = [(r.id, r.block, r.first_line, r.last_line, list(r.lines)[:1]) for r in text.segment_blocks(df, "t", "^ERROR", "query", "WARN").orderBy("id", "block").collect()]
    assert got == [(1, 0, 0, 3, ["query a"]), (1, 1, 4, 5, ["ERROR 2"]), (1, 2, 6, 9, ["WARN y"]), (1, 3, 10, 12, ["query c"]), (5, 0, 0, 1, ["WARN a"])]


def test_json_in_answers(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Yes: {"a": {"b": 2}} fine', "[1, 2]", "no", None, "", '```\n{"a": \n```', '"text"']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(expr.fenced_json(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', "[1, 2]", None, None, None, None, None]


def test_key_values(spark):
    df = spark.createDataFrame([('took=12ms, hits: 3 path="/x y"',), ("mistook=9",), (None,)], "t string")
    got = df.select(*[expr.key_value(F.col("t"), k, "none") for k in ("took", "hits", "path")]).collect()
    assert [tuple(r) for r in got] == [("12ms", "3", "/x"), ("none", "none", "none"), ("none", "none", "none")]


def test_two_row_header_needs_two_rows(spark, tmp_path):
    spark.createDataFrame([("only",)], "a string").coalesce(1).write.csv(str(tmp_path / "h"))
    with pytest.raises(ValueError):
        io.read_two_row_header(spark, str(tmp_path / "h"))


def test_rules_are_built_once_per_header(spark, tmp_path):
    cache = mapping.RuleCache(spark, str(tmp_path))
    build = lambda columns: {"x": ("copy", columns[0]), "y": ("blank", None)}
    first = cache.rules(["A", "b"], build)
    assert first == cache.rules([" a", "B "], build) == {"x": ("copy", "A"), "y": ("blank", None)} and cache.built == 1
    cache.rules(["b", "a"], build)
    assert cache.built == 2
    assert mapping.RuleCache(spark, str(tmp_path)).rules(["a", "b"], build) == first


def test_tokens_later_rows_win_and_nulls_stay(spark):
    tokens = spark.createDataFrame([(1, 1, "a", "old", "src"), (1, 2, "a", "new", "src"), (1, 1, "b", None, "src"), (2, 1, "a", "x", "as is")], "id int, seq int, token string, value string, source string")
    templates = spark.createDataFrame([(1, "{a}-{b}-{c}"), (2, "="), (3, "{a}"), (4, None)], "id int, template string")
    assert rows(mapping.fill_tokens(templates, tokens, ["id"])) == sorted([(1, "{a}-{b}-{c}", "new-{b}-{c}"), (2, "=", "as is"), (3, "{a}", "{a}"), (4, None, None)], key=repr)


def test_failed_database_load_leaves_the_table_as_it_was(spark):
    url, options = "jdbc:derby:memory:failing;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    io.write_jdbc(spark.createDataFrame([(1,)], "ID int"), url, "T", **options)
    broken = spark.createDataFrame([(2,), (3,)], "ID int").repartition(2).select(F.when(F.col("ID") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("ID")).cast("int").alias("ID"))
    with pytest.raises(Exception):
        io.write_jdbc(broken, url, "T", **options)
    assert rows(io.read_jdbc(spark, url, "SELECT ID FROM T", **options)) == [(1,)]


def test_members_and_names(spark):
    df = spark.createDataFrame([("Smith, Ann B", "0"), ("Bo", "(12.5)"), (None, ""), ("Ann  Li ", "x")], "n string, m string")
    got = mapping.column_rules(df, {"f": ("name_first", "n"), "l": ("name_last", "n"), "c": ("member_count", "m")})
    assert [tuple(r) for r in got.collect()] == [("Ann", "Smith", "1"), ("Bo", "", "-1"), ("", "", ""), ("Ann", "Li", "")]


def test_envelopes(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None), ("b", 2, "z"), ("b", 3, "q"), (None, 5, "n")], "l string, i int, v string")
    got = {r.l: r.payload for r in io.json_envelope(df, "l", ["i", "v"], max_rows=2).collect()}
    assert got == {"a": '{"load_id":"a","results":[{"i":1,"v":"x"},{"i":2,"v":"y"}]}', "b": None, None: '{"results":[{"i":5,"v":"n"}]}'}
    io.write_envelopes(df, "l", ["i", "v"], str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "load_id=b")).count() == 3


def test_materialized_by_source_and_columns(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2, "b")], "x int, y string")
    first = io.materialized(one, str(tmp_path), ["x", "y"], "one")
    assert rows(first) == [(1, "a")] == rows(io.materialized(two, str(tmp_path), ["y", "x"], "one").select("x", "y"))
    assert rows(io.materialized(two, str(tmp_path), ["x", "y"], "two")) == [(2, "b")]
