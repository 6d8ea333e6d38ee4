import pytest
from oracle import compare, connection

from codeweft.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, connection(FOLDER), FOLDER, registry.QUERIES[name], registry.SQL[name])


def test_the_driver_contract_lists_every_query():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(registry.QUERIES) <= set(q) and set(s) <= set(q)
    assert all(any(k.startswith(f"p{n}_") for k in q) for n in range(1, 11))
