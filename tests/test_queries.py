"""Every registered query of the mapping engine against its SQL on the smallest tables, and questions about specifications against the rows they must give."""

import os

import duckdb
import pytest

from weftline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else str(v)


def same(got, duck, sql):
    columns = sorted(got.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    found = duck.execute(sql)
    order = sorted((d[0], i) for i, d in enumerate(found.description))
    assert columns == [n for n, _ in order]
    assert mine == sorted(str([plain(r[i]) for _, i in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.examples()))
def test_example(spark, name):
    ask, rows = registry.examples()[name]
    same(ask(spark, DATA), duckdb.connect(), rows)
