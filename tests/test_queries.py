import pytest

import __spark_entry__
from tests.check_queries import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query_agrees_with_sql(spark, con, name):
    ok, message, _ = compare(spark, con, SMALL, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql().get(name))
    # At this size a few results are rightly empty.
    assert ok or message.startswith("0 rows"), message


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
