"""Every query of the core against its SQL, and those without SQL for rows."""

import pytest

from lodestone.plans import registry
from tests.compare import rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, name):
    cols, rows = rows_of(QUERIES[name](spark, small))
    want_cols, want = rows_of_sql(duck, SQL[name])
    assert cols == want_cols
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_names_are_known():
    assert set(SQL) <= set(QUERIES)
