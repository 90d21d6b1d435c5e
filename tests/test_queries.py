"""Queries against their SQL on the smallest tables: one of each family here, all of them by the driver."""

import os

import duckdb
import pytest

import __spark_entry__
from driftloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["c09_allreduce", "c20_all_to_allv", "d10_fork_join", "k16_queue_replay", "b02_batch_status", "g05_migrated_rank_hosts", "a10_repack_plan", "m02_deliver", "p01_batch_validity", "s03_occupancy_placements", "f05_names",
          "u04_chained_tasks", "t01_reorder", "t02_live_state", "t05_host_sessions", "t06_merge_diffs", "d10_overlaps", "d14_paged_delta_xor", "k18_conditional_writes", "p05_host_registry", "p03_fill_fields", "b04_flight_report", "c18_allgatherv", "t03_batch_progress"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, result.fetchall())


def test_catalog():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
