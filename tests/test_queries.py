"""Every query against its SQL form on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert not [t for _, t in df.dtypes if t.startswith("map")]
    if name in catalog.ORACLES:
        c = db.execute(catalog.ORACLES[name])
        assert got == rows([d[0] for d in c.description], c.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
