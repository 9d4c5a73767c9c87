"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from gridspan import oracles, queries
from tests.oracle import agree


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    agree(spark, sf_dir, queries.QUERIES[name], oracles.ORACLES[name])
