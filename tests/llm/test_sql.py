"""Registered queries against their SQL."""

import pytest

from checks.compare import connect, rows_of
from joingrove.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = Q.queries()[name](spark, sf)
    cursor = connect(sf).execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())
