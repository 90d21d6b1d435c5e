"""Running aggregates and folds: hot groups, null keys, ties."""

import random

from pyspark.sql import functions as F

from driftloom.operators import messaging, ordering


def test_running_in_a_hot_group_and_a_null_group(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(-50, 50)) for k, n in (("hot", 3000), (None, 500), ("small", 3)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    out = ordering.running(df, ["k"], ["i"], {"s": ("sum", "v"), "low": ("min", "v"), "high": ("max", F.col("v") * 2)}).collect()
    assert len(out) == len(rows)
    for key in ("hot", None, "small"):
        total, low, high = 0, 99, -999
        for r in sorted((r for r in out if r.k == key), key=lambda r: r.i):
            total, low, high = total + r.v, min(low, r.v), max(high, 2 * r.v)
            assert (r.s, r.low, r.high) == (total, low, high)


def test_numbers_with_null_keys(spark):
    df = spark.createDataFrame([(1, 2), (None, 5), (None, 4), (1, 1)], "k int, i int")
    assert sorted((str(r.k), r.i, r.n) for r in ordering.number_rows(df, ["k"], ["i"], "n").collect()) == [("1", 1, 0), ("1", 2, 1), ("None", 4, 0), ("None", 5, 1)]
    assert ordering.number_rows(df.filter("i > 9"), ["k"], ["i"], "n").isEmpty()


def test_null_channels_deliver(spark):
    df = spark.createDataFrame([(g, 0, 1, s, 10 - s) for g in (None, 7) for s in (0, 1, 3)], "group long, src long, dst long, seq long, arrival long")
    done, held = messaging.deliver(df)
    assert sorted((str(r.group), r.seq, r.ready) for r in done.collect()) == [("7", 0, 10), ("7", 1, 10), ("None", 0, 10), ("None", 1, 10)]
    assert sorted((str(r.group), r.seq) for r in held.collect()) == [("7", 3), ("None", 3)] and held.columns == df.columns


def test_fold_sorted_streams_each_key(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))

    def fold(key, rows):
        for n, (i,) in enumerate(rows):
            yield key[0], i, n

    out = ordering.fold_sorted(df, ["k"], ["i"], fold, "k long, i long, n long").collect()
    assert all(r.n == r.i // 3 for r in out) and len(out) == 5000
