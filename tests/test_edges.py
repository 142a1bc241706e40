"""The queries of the general problems on empty tables, tables of nulls, extra columns and repeats."""

import pytest

from tests.conftest import rows
from weftline.plans import problems

NAMES = sorted(problems.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert problems.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_all_null(spark, null_dir, name):
    problems.QUERIES[name](spark, null_dir).collect()


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_found")])
def test_extra_columns_change_nothing(spark, sf, clash_dir, name):
    f = problems.QUERIES[name]
    assert rows(f(spark, clash_dir)) == rows(f(spark, sf))


def test_repeats_p4(spark, sf, doubled_dir):
    assert rows(problems.p4_found(spark, doubled_dir)) == rows(problems.p4_found(spark, sf))
