"""The operators' queries against their SQL twins, where they have one."""

import pytest

from stowage.llm.registry import QUERIES, SQL

from ..conftest import canonical


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    plain = lambda frame: frame.astype(object).where(frame.notna(), None)
    got, want = plain(QUERIES[name](spark, sf).toPandas()), plain(duck.execute(SQL[name]).df())
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
