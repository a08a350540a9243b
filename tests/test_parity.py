"""Every query of the memory operators against its SQL twin."""

from __future__ import annotations

import pytest

from tessera.plans import catalogue

QUERIES = catalogue.queries()
SQL = catalogue.oracle_sql()


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
