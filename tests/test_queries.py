"""Every query that SQL can express, against DuckDB over the same tables."""

import pytest

from lamella.plans import registry
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    same_rows(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
