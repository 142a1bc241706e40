import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.jsontext import Num, _parse_deep, as_text, dump, parse, parse_unwrapped

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


@given(VALUES)
@settings(max_examples=80, deadline=None)
def test_both_parsers_read_what_was_written(v):
    text = json.dumps(v)
    assert _parse_deep(text) == parse(text)
    assert json.loads(dump(parse(text))) == v


@pytest.mark.parametrize("bad", ["", "  ", "{", "[1,]", '{"a":1,}', "{'a':1}", "NaN", "[Infinity]", '{"a" 1}', "1 2", "tru", "[]]", '"a', "01", "﻿1", '{"a":1}}', "[1 2]", '{"a"}'])
def test_not_well_formed(bad):
    for f in (parse, _parse_deep):
        with pytest.raises(ValueError):
            f(bad)


def test_numbers_as_written_and_wrapping():
    assert parse("1.50") == "1.50" and isinstance(parse("1.50"), Num)
    assert parse_unwrapped(json.dumps(json.dumps({"a": 7}))) == {"a": "7"}
    assert parse_unwrapped('"not json"') == "not json"
    assert as_text(parse('{"a":[1,true,null]}')) == '{"a":[1,true,null]}'
    assert as_text(parse(r'"\ud800"')) == "?"


def test_deeper_than_the_stack():
    n = 200_000
    v = parse("[" * n + "]" * n)
    depth = 0
    while v:
        v, depth = v[0], depth + 1
    assert depth == n - 1
