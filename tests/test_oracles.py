import pytest
from oracle import compare, connection

from codeweft.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, FOLDER, registry.QUERIES[name], registry.SQL[name])


#: Queries for whose construct these tables have no case; their operators are tested on fixtures (test_extract, test_code_graph).
NO_CASE = {"guard_conditions", "graph_violations", "tool_request_flow", "tool_bindings", "tool_outbound_apis", "tool_tests", "tool_security_surface"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_distinct_rows(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert (len(rows) == 0) == (name in NO_CASE)
    assert len({repr(r) for r in rows}) == len(rows)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
