import json

from tests.conftest import rows
from weftline.operators import nested


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    settled = nested.settle(nested.emit_nodes(df, "x", "row_id", "t"))
    return {tuple(r) for r in settled.filter("kind = 'element'").select("row_id", "node_path", "parent_path").collect()}


def test_positions_count_all_elements_and_parents(spark):
    t = json.dumps({"a": [None, {"b": [{"c": 1}, 5, {"d": {"e": [{}]}}]}], "o": {"p": [{}]}})
    assert found(spark, [t]) == {
        (0, "$.a[1]", "$"), (0, "$.a[1].b[0]", "$.a[1]"), (0, "$.a[1].b[2]", "$.a[1]"), (0, "$.a[1].b[2].d.e[0]", "$.a[1].b[2]"), (0, "$.o.p[0]", "$"),
    }


def test_object_alone_counts_as_element_only_where_lists_occur(spark):
    texts = ['{"a": [{"x": 1}], "s": {"y": 1}}', '{"a": {"x": 1, "b": {"z": 2}}, "s": {"y": 1}}', '{"a": [{"b": [{"z": 3}]}]}']
    got = found(spark, texts)
    assert {(1, "$.a[0]", "$"), (1, "$.a[0].b[0]", "$.a[0]")} <= got
    assert not any(".s" in p for _, p, _ in got)


def test_root_list_recursion_wrapping_and_broken(spark):
    q = [{"q": 1, "sub": [{"q": 2, "sub": {"q": 3}}]}]
    got = found(spark, [json.dumps(q), json.dumps(json.dumps(q)), None, "", "  ", "{", '"text"', "7", "[]", "[[{}]]"])
    want = {("$[0]", "$"), ("$[0].sub[0]", "$[0]"), ("$[0].sub[0].sub[0]", "$[0].sub[0]")}
    assert {(p, q) for i, p, q in got if i == 0} == want == {(p, q) for i, p, q in got if i == 1}
    assert {(p, q) for i, p, q in got if i == 9} == {("$[0][0]", "$")}
    assert {i for i, _, _ in got} == {0, 1, 9}


def test_very_deep_and_long(spark):
    n = 3000
    deep = '{"a":[' * n + "1" + "]}" * n
    got = found(spark, [deep])
    assert len(got) == n - 1


def test_join_form_agrees_with_the_array_form(spark):
    texts = ['{"a": [{"x": 1}], "s": {"y": 1}}', '{"a": {"x": 1, "b": {"z": 2}}}', '{"a": [{"b": [{"z": 3}]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    nodes = nested.emit_nodes(df, "x", "row_id", "t")
    cols = ["row_id", "tag", "kind", "node_path", "parent_path"]
    assert rows(nested.settle(nodes).select(*cols)) == rows(nested.settle(nodes, max_tags=0).select(*cols))


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": [{"x": 1, "y": "b", "node_path": true}, {"x": 2}, {}]}'), (2, '{"a": {"y": 7}}'), (3, None)], "row_id long, t string")
    path = str(tmp_path / "t")
    nested.write_tables(nested.settle(nested.emit_nodes(df, "s", "row_id", "t")), path)
    one = nested.read_table(spark, path, "s", "a")
    assert one.columns == ["row_id", "node_path", "parent_path", "node_path_2", "x", "y"]
    want = [(1, "$.a[0]", "$", True, 1, "b"), (1, "$.a[1]", "$", None, 2, None), (1, "$.a[2]", "$", None, None, None), (2, "$.a[0]", "$", None, None, "7")]
    assert rows(one) == sorted(want, key=repr)
    typed = nested.read_table(spark, path, "s", "a", {"x": "string", "y": "int", "z": "date"})
    assert dict(typed.dtypes)["y"] == "int" and rows(typed.select("x", "y", "z")) == sorted([("1", None, None), ("2", None, None), (None, None, None), (None, 7, None)], key=repr)
    assert rows(nested.read_table(spark, path, "s", "").select("row_id", "node_path")) == [(1, "$"), (2, "$")]
    assert nested.read_table(spark, path, "s", "no such tag").count() == 0


def test_every_leaf_is_in_one_payload(spark):
    def leaves(v):
        below = v.values() if isinstance(v, dict) else v if isinstance(v, list) else None
        return [json.dumps(v)] if below is None else [x for b in below for x in leaves(b)]

    texts = [{"a": {"lines": ["x", None, "é"]}, "k": 1}, {"a": [{"lines": ["y"], "m": [[1, [2.5]], {"z": True}]}]}, ["r", 7, {"s": "t"}], "alone"]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "row_id long, t string")
    got = nested.settle(nested.emit_nodes(df, "x", "row_id", "t")).collect()
    for i, t in enumerate(texts):
        assert sorted(json.dumps(v) for r in got if r.row_id == i for v in json.loads(r.payload).values()) == sorted(leaves(t))
    values = {(r.row_id, r.tag, r.node_path, r.parent_path, r.payload) for r in got if r.kind == "value"}
    assert (0, "a.lines[]", "$.a[0].lines[0]", "$.a[0]", '{"value":"x"}') in values
    assert (1, "a.m[]", "$.a[0].m[0][1][0]", "$.a[0]", '{"value":2.5}') in values
