"""Every registered query against its SQL, all rows, noise included."""

import pytest

from cellview.catalog import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", list(registry()))
def test_query_equals_sql(name, spark, con, sf):
    assert compare(registry()[name], spark, con, sf) == ""


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    df = driver.entry(spark)
    assert df.columns == ["query_id", "estimate"]
    assert df.count() == 10
