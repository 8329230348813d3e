"""Every query of the engine proper against DuckDB on the smallest tables."""

import pytest

from stowage import catalog

from .conftest import canonical


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert name in catalog.SQL, "every query has a twin"
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
