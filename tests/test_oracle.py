import pytest

from oracle import connection, rows_of, sql_rows
from textquarry.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_same_rows_as_sql(spark, con, name):
    ours = rows_of(q.queries()[name](spark, SF))
    assert ours == sql_rows(con, q.oracle_sql()[name])
    assert ours
