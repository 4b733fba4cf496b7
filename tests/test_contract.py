"""Driver contract: entry runs, every query has a stable schema, and every
oracle SQL matches its Spark query on the smallest data set."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["topic", "route", "error_type", "n"]


def test_every_query_has_an_oracle():
    own = {k for k in E.queries() if k != "pipeline" and not k.startswith("op")}
    assert own == {k for k in E.oracle_sql() if k in own} and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] in ("MATCH", "rows-only"), r
