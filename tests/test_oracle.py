"""Every registered query against its SQL."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from spoolworks.plans import catalog

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    result = oracle.compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert result["ok"], result["why"]
    assert result["rows"] > 0


def test_every_library_query_has_sql():
    assert set(catalog.callables()) <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "text"]
    assert df.count() == 20
