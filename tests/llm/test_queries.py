import pytest

from foliant.llm import queries as q
from tests.oracle import compare

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    compare(spark, small, q.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_no_row_twice(spark, small, name):
    frame = q.queries()[name](spark, small)
    assert frame.count() == frame.distinct().count()
