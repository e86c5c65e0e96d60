"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from siltstone.plans.catalog import load

from .conftest import DATA, same

QUERIES = load()
NONE = {"regenerated_embeddings"}  # every document of the smallest tables has its vector


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, duck, name):
    same(QUERIES[name].build(spark, DATA), duck.execute(QUERIES[name].sql))


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    df = QUERIES[name].build(spark, DATA)
    assert df.columns and bool(df.limit(1).collect()) == (name not in NONE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
