import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from compare import connect, difference
from tactile.plans.oracles import ORACLES
from tactile.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    expected = sql.sql(ORACLES[name]).df()
    actual = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(actual) > 0
    assert difference(actual, expected) == ""


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["doc_id", "page_idx", "glyphs", "raised"] and df.limit(1).count() == 1


def test_entry_without_the_training_data_part():
    """The queries of the library are there when the folders of that part are not."""
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tactile.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], done.stderr
