"""Every query against its SQL, on the smallest tables; the subpackage's queries have tests of their own."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog.operators import latest
from stratalog.plans.oracles import ORACLES
from stratalog.plans.queries import QUERIES, events_log
from stratalog.sources import oplog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(int(value)) if isinstance(value, (bool, int)) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = sql.execute(ORACLES[name])
    assert sorted(c[0] for c in want.description) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    want_rows = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want_rows


def test_every_query_has_sql():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == {"c3_levels"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("first, years", [(999_500, 0), (6_000_000, 0), (0, 80), (999_500, 80)])
def test_deletes_among_any_numbers(spark, sql, tmp_path, first, years):
    """The log's own seq or ts may reach those of the deletes; only the deletes are returned, and all of them."""
    sql.execute(f"COPY (SELECT * REPLACE (event_id + {first} AS event_id, ts + INTERVAL {years} YEAR AS ts) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"SELECT key, value, tombstone, seq FROM ({ORACLES['d_delete']})").fetchall())
    assert want and sorted(map(tuple, QUERIES["d_delete"](spark, str(tmp_path)).select("key", "value", "tombstone", "seq").collect())) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_deletes_take_effect(spark):
    """The tombstones, put into the log, win over it: their keys are gone, with the values kept, and no other key is."""
    log = events_log(spark, DATA)
    dead = QUERIES["d_delete"](spark, DATA)
    after = log.unionByName(oplog.records(dead.withColumn("ts", F.lit(4_000_000_000))))
    gone = {r.key for r in dead.collect()}
    assert gone and {r.key for r in latest.live(log).collect()} - {r.key for r in latest.live(after).collect()} == gone
    assert {(r.key, bytes(r.value).decode()) for r in latest.latest(after).where(F.col("key").isin(*gone)).collect()} == {(r.key, r.value) for r in dead.collect()}
