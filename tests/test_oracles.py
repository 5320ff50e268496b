"""Every registered query against its SQL on DuckDB, on the smallest test data."""

import pytest

from __spark_entry__ import entry
from stepframe.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


catalog.load_all()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    assert compare(catalog.QUERIES[name](spark, FOLDER), duck, catalog.ORACLES[name]) == ""


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_proves_its_summary(spark):
    rows = entry(spark).collect()
    assert {r.item for r in rows if r.section == "check"} == {"schema_parity", "row_count", "aggregate_parity"}
    assert all(r.status == "pass" for r in rows if r.section == "check")
    assert len([r for r in rows if r.section == "summary"]) == 5
