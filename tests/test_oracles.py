"""Every registered query against the independent SQL engine, on whole tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from shelfscope import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {n: KINDS[t] for n, t in df.dtypes} == {d[0]: str(d[1]) for d in cursor.description}
    assert by_name(df.columns, rows) == by_name(names, expected)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["brand", "items", "share_pct"]
