"""Registered queries against their SQL on the smallest given tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import oracle_sql
from checks.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    verdict, _, _ = compare(spark, db, SF, name)
    assert verdict.startswith("ok"), verdict
