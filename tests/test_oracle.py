"""Every query with check SQL gives the same rows as that SQL."""

import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    problem, count = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None
    assert count > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the numbered operators and the pipeline have their own tests
    unchecked = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", n)}
    assert unchecked == {"panel_trees", "end_to_end_forecast"}
