"""The registered queries, their SQL and the entry point."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:1] == ["k"] and df.count() == 2


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_raster_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessella.plans import catalog, oracle

    c = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    sql = oracle.oracle_sql()
    for name, query in catalog.queries().items():
        if name not in sql:
            continue
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        got = sorted([tuple(r[x] for x in columns) for r in df.collect()], key=repr)
        found = c.sql(sql[name])
        at = [list(found.columns).index(x) for x in columns]
        assert got == sorted([tuple(r[i] for i in at) for r in found.fetchall()], key=repr), name


LOGS = ("early_stop", "epoch_loss", "batch_f1", "running_loss", "lr_schedule", "weighted_ce", "weighted_ce_probs")
TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_log_queries_use_every_event(spark):
    """Several runs per type, so the runs after the first are compared as well."""
    duckdb = pytest.importorskip("duckdb")
    from tessella.plans import catalog, oracle
    from tessella.sources import fixtures

    c = duckdb.connect()
    c.sql(f"create view events as select * from read_parquet('{TABLES}/events.parquet')")
    assert fixtures.epochs(spark, TABLES).count() == c.sql("select count(*) from events").fetchall()[0][0] > 5 * 300
    for name in LOGS:
        df = catalog.queries()[name](spark, TABLES)
        columns = sorted(df.columns)
        found = c.sql(oracle.oracle_sql()[name])
        at = [list(found.columns).index(x) for x in columns]
        got = sorted([tuple(r[x] for x in columns) for r in df.collect()], key=repr)
        assert got == sorted([tuple(r[i] for i in at) for r in found.fetchall()], key=repr), name
