import pytest

from sluice.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])
