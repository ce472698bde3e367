from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from tracelattice.plans import queries as engine

    db = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in engine.ORACLES.items():
        df = engine.QUERIES[name](spark, SMALL)
        columns = sorted(df.columns)
        ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
        found = db.sql(sql)
        names = list(found.columns)
        theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
        assert ours == theirs, name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 612
