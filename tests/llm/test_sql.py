import pytest

from tests.sql import assert_equal
from wortsee.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    assert_equal(spark, QUERIES[name], SQL[name], data)
