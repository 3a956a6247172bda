import pytest

from tests.compare import assert_same
from thicket import engine_queries  # noqa: F401  registers its queries
from thicket import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(q.QUERIES[name](spark, sf).toPandas(), q.ORACLES[name], sf)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLES)
