"""The training-data queries that SQL can express, against DuckDB over the same tables."""

import pytest

from lamella.llm import queries
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
