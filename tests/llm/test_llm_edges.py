"""The queries of the problems on training data on empty tables, tables of nulls, extra columns."""

import pytest

from tests.conftest import rows
from weftline.llm import queries

NAMES = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_all_null(spark, null_dir, name):
    queries.QUERIES[name](spark, null_dir).collect()


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_found") or n in ("p7_ids", "p8_selection")])
def test_extra_columns_change_nothing(spark, sf, clash_dir, name):
    f = queries.QUERIES[name]
    assert rows(f(spark, clash_dir)) == rows(f(spark, sf))


@pytest.mark.parametrize("name", ["p6_found", "p9_classes"])
def test_repeated_rows(spark, sf, doubled_dir, name):
    f = queries.QUERIES[name]
    assert set(rows(f(spark, doubled_dir))) == set(rows(f(spark, sf)))
