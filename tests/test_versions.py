"""Versioned tables: readers see committed rows only, repeated batches change nothing, old versions go."""

import os

import pytest
from pyspark.sql import functions as F

from driftloom.operators.versions import Manifest, VersionedTable
from driftloom.streaming import jobs as j


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", ["k"], buckets=4)


def content(df):
    return {r.k: r.v for r in df.collect()}


def files(table):
    return sorted(x for x in os.listdir(table.path.removeprefix("file://")) if x.startswith("v="))


def test_upserts_read_back_by_version(spark, table):
    with pytest.raises(ValueError):
        table.read()
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    table.upsert(rows(0, 50, "old"))
    table.upsert(rows(40, 60, "new"), {"by": "me"})
    assert content(table.read()) == {k: "new" if k >= 40 else "old" for k in range(60)}
    assert content(table.read(0)) == dict.fromkeys(range(50), "old")
    assert table.manifest().note == {"by": "me"}
    one = table.upsert(rows(7, 8, "one"))
    assert sum(v == 2 for v in one.buckets.values()) == 1  # the other buckets keep their files
    table.compact()
    assert table.clean() == [0, 1, 2] and files(table) == ["v=3"]
    assert content(table.read()) == {k: "one" if k == 7 else "new" if k >= 40 else "old" for k in range(60)}


def test_a_writer_that_stops_half_way_changes_nothing(spark, table, monkeypatch):
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table.upsert(rows)

    def stop(self, made):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", stop)
        with pytest.raises(OSError):
            table.upsert(rows.withColumn("v", F.lit("lost")))
    assert files(table) == ["v=0", "v=1"] and content(table.read()) == dict.fromkeys(range(20), "old")
    table.upsert(rows.filter("k < 3").withColumn("v", F.lit("next")))
    assert content(table.read()) == {k: "next" if k < 3 else "old" for k in range(20)}
    with pytest.raises(ValueError):
        table._publish(Manifest(1))  # a second writer of the same number


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    write = j.upsert_into(path, ["k"], buckets=2, keep=1)
    rows = lambda v: spark.range(4).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    write(rows(1), 0)
    write(rows(2), 1)
    before = VersionedTable(spark, path, []).manifest()
    write(rows(2), 1)
    assert VersionedTable(spark, path, []).manifest() == before
    assert content(j.read_upserts(spark, path)) == dict.fromkeys(range(4), 2)
    assert files(VersionedTable(spark, path, [])) == ["v=1"]
