"""Every registered query against its SQL over whole tables."""

import pytest

import __spark_entry__ as entry
from listingloom.plans.catalog import QUERIES
from listingloom.plans.oracles import ORACLES
from oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    result = entry.queries()[name](spark, SF_DIR)
    assert differences(result, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "id", "company_name", "date_posted"]
