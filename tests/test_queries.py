"""Every registered query with SQL gives the rows that DuckDB gives."""

import oracle
import pytest

from quern import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_as_sql(spark, con, name):
    assert oracle.differs(spark, con, plans.queries()[name], plans.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).collect() is not None
