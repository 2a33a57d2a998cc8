"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tabprep.queries import QUERIES, SQL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, duck, SQL[name]) is None
    else:
        assert df.toArrow().num_rows > 0


def test_entry_point(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
