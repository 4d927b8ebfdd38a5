"""Every registered query with an oracle equals its DuckDB SQL at sf0.001."""

import hashlib
import math

import pytest

import __spark_entry__
from catalytics.plans import catalogue as E
from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_entry_smoke(spark):
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["place", "row_seq", "name", "price_numeric", "rating_numeric", "sales_numeric",
                          "discount_percentage_numeric", "score"]


def test_every_query_has_an_oracle_and_is_registered():
    assert set(E.queries()) == set(E.oracle_sql()) <= set(__spark_entry__.queries())


_TYPES = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
          "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_types_match_oracle(spark, duck, name):
    spark_types = {f.name: _TYPES.get(str(f.dataType), str(f.dataType))
                   for f in E.queries()[name](spark, SF_SMALL).schema.fields}
    rel = duck.sql(E.oracle_sql()[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
