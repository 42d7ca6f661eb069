"""Every registered query against its SQL on the smallest data folder."""

import pytest

from folio_spark.workloads import ORACLES, QUERIES
from folio_spark.workloads.check import mismatch, oracle_connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    problem, rows = mismatch(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None, problem
    assert rows > 0
