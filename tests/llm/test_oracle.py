"""Queries of this subpackage that SQL can express equal their DuckDB SQL."""

import collections

import pytest

from catalytics.llm import registry
from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_SMALL)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(found.fetchall())
