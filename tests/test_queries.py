"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from corvane.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows and df.columns
        return
    expect = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expect.columns)
    at = [expect.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in expect.fetchall()), key=repr)
    assert ours == theirs


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
