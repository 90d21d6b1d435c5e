"""Occupancy files by blocks, and paged deltas by hash trees."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import diffmerge as d
from driftloom.sources import tasks as t


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_occupancy_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rng, lines = random.Random(6), ["WorkerIp,Slots"]
    for i in range(20_000):
        lines.append(",".join([f"10.0.{i // 250}.{i % 250}", *[str(rng.choice([-1, 1, 1, 2, 3])) for _ in range(rng.randrange(6))]]) + ("\r" if i % 3 == 0 else ""))
    (tmp_path / "one.csv").write_text("\n".join(lines))
    (tmp_path / "two.csv").write_text("WorkerIp,Slots\nh,7,-1,7\n\ng\n")
    assert t.occupancy_lines(spark, f"file://{tmp_path}").select(F.spark_partition_id()).distinct().count() > 5
    hosts, placed = t.read_occupancy(spark, f"file://{tmp_path}")
    name = F.regexp_extract("file", "([a-z]+).csv", 1)
    want_hosts, want_placed, numbers = set(), set(), {}
    for file, rows in (("one", lines[1:]), ("two", ["h,7,-1,7", "g"])):
        for line in rows:
            host, *apps = line.rstrip("\r").split(",")
            want_hosts.add((file, host, len(apps), sum(a != "-1" for a in apps)))
            for a in apps:
                if a != "-1":
                    n = numbers[file, a] = numbers.get((file, a), -1) + 1
                    want_placed.add((file, int(a), n, host))
    assert {tuple(r) for r in hosts.withColumn("file", name).collect()} == want_hosts
    assert {tuple(r) for r in placed.withColumn("file", name).collect()} == want_placed


def pages_of(spark, texts):
    rows = [(name, p, bytearray(data[p * d.PAGE : (p + 1) * d.PAGE])) for name, data in texts.items() for p in range(-(-len(data) // d.PAGE))]
    return spark.createDataFrame(rows, "dataset string, page long, bytes binary")


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_deltas_by_hash_trees(spark, monkeypatch, few):
    monkeypatch.setattr(d, "FEW_PAGES", few)
    rng = random.Random(9)
    old = {"a": rng.randbytes(d.PAGE * 200 + 17), "b": rng.randbytes(d.PAGE * 64), "c": rng.randbytes(100), "same": rng.randbytes(d.PAGE * 130), "gone": b"x"}
    new = {k: bytearray(v) for k, v in old.items() if k != "gone"}
    new["a"][d.PAGE * 70 + 5] ^= 1
    new["b"] += bytes(d.PAGE) + b"more"
    new["c"] = bytearray(rng.randbytes(90))
    new["fresh"] = bytearray(b"0" * 10)
    new = {k: bytes(v) for k, v in new.items()}
    before, after = pages_of(spark, old), pages_of(spark, new)
    changed = {(r.dataset, r.page) for r in d.changed_pages(d.hash_tree(before), d.hash_tree(after)).collect()}
    assert changed == {("a", 70), ("a", 200), ("b", 65), ("c", 0), ("fresh", 0)}
    for xor in (True, False):
        delta = d.paged_delta(before, after, xor)
        assert {(r.dataset, r.page) for r in delta.filter("kind <> 'SIZE'").collect()} == changed
        made = {}
        for r in d.apply_paged_delta(before, delta).orderBy("dataset", "page").collect():
            made[r.dataset] = made.get(r.dataset, b"") + bytes(r.bytes)
        assert made == new


def test_equal_pages_are_not_shuffled(spark, tmp_path):
    pages = pages_of(spark, {"a": bytes(range(256)) * 640})
    pages.write.parquet(f"file://{tmp_path}/old")
    pages.withColumn("bytes", F.when(F.col("page") == 3, F.lit(b"x" * d.PAGE)).otherwise(F.col("bytes"))).write.parquet(f"file://{tmp_path}/new")
    old, new = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("old", "new"))
    delta = d.paged_delta(old, new, xor=False, trees=(d.hash_tree(old).cache(), d.hash_tree(new).cache()))
    plan = delta.filter("kind <> 'SIZE'")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert [r.page for r in delta.filter("kind <> 'SIZE'").collect()] == [3]


def test_dirty_pages_of_cells(spark):
    base = spark.range(20_000).select(F.lit("d").alias("dataset"), F.col("id").alias("slot"), (F.col("id") % 7).alias("value"))
    new = base.withColumn("value", F.when(F.col("slot").isin(5, 9000), F.lit(100).cast("long")).otherwise(F.col("value")))
    dirty = d.dirty_pages(d.cell_page_hashes(base), d.cell_page_hashes(new))
    assert sorted(r.page for r in dirty.collect()) == [0, 2]
    regions = spark.createDataFrame([("d", 0, 0, "sum")], "dataset string, lo long, len long, op string")
    assert {(r.slot, r.delta) for r in d.diff_regions(base, new, regions, dirty).collect()} == {(5, 95), (9000, 100 - 9000 % 7)}
