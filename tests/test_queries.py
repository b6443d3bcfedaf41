"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from check import compare

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    problem, _ = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
