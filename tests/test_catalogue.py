import pytest

from sluice.plans import catalogue, services  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
