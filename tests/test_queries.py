import pytest

from genolith.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
