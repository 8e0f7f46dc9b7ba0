"""Every registered query that SQL can express gives the rows that DuckDB gives."""

import pytest

from tests.compare import connect, rows_of_spark, rows_of_sql
from tidemark import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    columns, rows = rows_of_spark(registry.QUERIES[name](spark, sf_dir))
    expected_columns, expected = rows_of_sql(con, registry.ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
