import pytest

from genolith.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") > 0
