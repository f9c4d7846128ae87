"""Every registered query against its SQL on the same tables."""

import pytest

from checks.compare import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    assert compare(spark, con, sf, name) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
