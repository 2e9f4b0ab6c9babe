"""Every query with an SQL twin must give the same rows."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from adloom.catalog.oracles import ORACLES
from adloom.catalog.queries import QUERIES

SQLS = oracle_sql()
HEAVY = {"train_dnn_embedding", "train_dnn_discrete"}


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_rows(spark, con, small, name):
    assert check.difference(queries()[name](spark, small), con, SQLS[name]) is None


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == HEAVY


@pytest.mark.parametrize("name", sorted(HEAVY))
def test_runs(spark, small, name):
    assert queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 1
