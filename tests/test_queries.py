"""Every registered query against its check query in DuckDB."""

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from tidewatch.catalog.registry import ORACLES, QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, FOLDER)[0].startswith("ok")


def test_all_have_a_check_query():
    assert set(ORACLES) == set(QUERIES)
