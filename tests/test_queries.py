"""Every registered query against its SQL: rows, values and column types."""

import pytest
from oracle import SAME_TYPE, normal, run_sql

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data_dir, name):
    got = QUERIES[name](spark, data_dir)
    names, kinds, expected = run_sql(SQL[name], data_dir)
    types = {f.name: SAME_TYPE[f.dataType.simpleString()] for f in got.schema}
    assert types == dict(zip(names, kinds, strict=True))
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal(names, expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
