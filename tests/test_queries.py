import pytest

import __spark_entry__ as entry_points
import workload
from tests.oracle import differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = workload.QUERIES
ORACLES = workload.ORACLES


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLES.keys() <= entry_points.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
