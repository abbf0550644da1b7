"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, db, name):
    ok, note = oracle.compare(spark, name, contract.queries()[name], SQL.get(name), FOLDER, db)
    assert ok, note


def test_names_are_in_the_query_list():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0
