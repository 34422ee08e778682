"""Registered queries of the subpackage against their DuckDB oracles, and that all of them run."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from oracle_check import check, duck

QUERIES = {k: v for k, v in E.queries().items() if re.match(r"op\d+_|pipeline$", k)}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_all_are_registered():
    assert {re.match(r"op\d+|pipeline", k)[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    r = check(spark, con, name, QUERIES[name], ORACLE.get(name), SF_ORACLE, verbose=True)
    assert r["status"] in ("match", "rows-only"), r
    assert r["rows"] > 0
