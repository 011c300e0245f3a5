import pytest
from compare import connect, difference

from tactile.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = connect(SF)
    expected = con.sql(ORACLES[name]).df()
    con.close()
    actual = QUERIES[name](spark, SF).toPandas()
    assert len(actual) > 0
    assert difference(actual, expected) == ""
