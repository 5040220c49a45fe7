"""Registered queries against their SQL."""

import oracle
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    import re

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    assert all(isinstance(s, str) for s in queries.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_sql(spark, name):
    assert oracle.differs(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None
