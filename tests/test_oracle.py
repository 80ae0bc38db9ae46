"""Every registered query against its check SQL, on the whole small tables."""

import pytest

import __spark_entry__ as entry_module
import check
from corpuslens import plans

SF_DIR = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, con, name):
    ok, message, _ = check.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_every_query_has_a_check():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20
