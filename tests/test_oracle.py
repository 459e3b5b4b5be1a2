"""Every SQL-checked catalogue query equals its DuckDB oracle on sf0.001
(row count, column names, order-insensitive exact values), and the driver
contract holds."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_harness  # noqa: E402

from txnrisk.plans.registry import load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
REG = load_all()
SQL_KEYS = sorted(k for k, v in REG.items() if v.sql)


@pytest.fixture(scope="module")
def con():
    return oracle_harness.duck(SF)


@pytest.mark.parametrize("name", SQL_KEYS)
def test_query_matches_oracle(spark, con, name):
    r = oracle_harness.compare(spark, name, REG[name], SF, con)
    assert r["ok"], r


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "risk_level" in df.columns
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
