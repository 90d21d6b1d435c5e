"""Exact cases of the collectives, and laws that they keep."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import collectives as c


def ranked(spark, size, slots, value):
    return spark.createDataFrame([("w", r, s, value(r, s)) for r in range(size) for s in range(slots)], "world string, rank int, slot long, value long")


def values(df, *by):
    return [r.value for r in df.orderBy(*by).collect()]


@pytest.mark.parametrize("op,first,expected", [("sum", 0, [10, 100, 1000]), ("max", 0, [4, 40, 400]), ("sum", 1, [15, 150, 1500]), ("max", 1, [5, 50, 500]), ("min", 1, [1, 10, 100])])
def test_reduce(spark, op, first, expected):
    df = ranked(spark, 5, 3, lambda r, s: (r + first) * 10**s)
    assert values(c.reduce(df, op), "slot") == expected
    assert values(c.allreduce(df, op).filter("rank = 3"), "slot") == expected


def test_reduce_double(spark):
    df = spark.createDataFrame([("w", r, s, (2.5 + r) * 10**s) for r in range(5) for s in range(3)], "world string, rank int, slot long, value double")
    assert values(c.reduce(df, "sum"), "slot") == [22.5, 225, 2250]
    assert values(c.reduce(df, "min"), "slot") == [2.5, 25, 250]


def test_scan(spark):
    df = ranked(spark, 5, 3, lambda r, s: 10 * r + s)
    assert values(c.scan(df).filter("slot = 0"), "rank") == [0, 10, 30, 60, 100]


def test_gather_scatter_broadcast(spark):
    df = ranked(spark, 5, 3, lambda r, s: 3 * r + s)
    assert values(c.gather(df, 3), "slot") == list(range(15))
    back = c.scatter(c.gather(df, 3), 3)
    assert back.exceptAll(df.select("world", F.col("rank").cast("long"), "slot", "value")).isEmpty()
    assert values(c.broadcast(df, 3).filter("rank = 0"), "slot") == [9, 10, 11]


def test_all_to_all(spark):
    df = ranked(spark, 4, 8, lambda r, s: 10 * r + s)
    out = c.all_to_all(df, 2)
    assert values(out.filter("rank = 0"), "slot") == [0, 1, 10, 11, 20, 21, 30, 31]
    assert values(out.filter("rank = 3"), "slot") == [6, 7, 16, 17, 26, 27, 36, 37]
    assert c.all_to_all(out, 2).exceptAll(df).isEmpty()


@pytest.mark.parametrize("d0,d1,shifts", [(5, 1, [(4, 1), (0, 0), (0, 0)]), (2, 2, [(2, 2), (1, 1), (0, 0)])])
def test_grid(spark, d0, d1, shifts):
    size = d0 * d1
    df = spark.createDataFrame([("w", r, size, d0, d1) for r in range(size)], "world string, rank int, size int, d0 int, d1 int")
    at = c.grid_coords(df).orderBy("rank").collect()
    assert [(r.c0, r.c1, r.c2) for r in at] == [(r // d1, r % d1, 0) for r in range(size)]
    for axis, expected in enumerate(shifts):
        r = c.grid_shift(df, axis).filter("rank = 0").first()
        assert (r.source, r.dest) == expected
    assert c.grid_rank(c.grid_coords(df).drop("rank")).count() == size


def test_two_level_broadcast_counts(spark):
    df = spark.createDataFrame([("w", r, f"h{r // 2}") for r in range(4)], "world string, rank int, host string")
    sent = lambda root: {r.rank: r.local + r.remote for r in c.exchange_counts(df, root, "broadcast").collect()}
    assert sent(0) == {0: 2, 1: 0, 2: 1, 3: 0}
    assert sent(1) == {0: 0, 1: 2, 2: 1, 3: 0}


def test_matching_reports_unmatched(spark):
    s = spark.createDataFrame([("w", 0, 1, 1, 5), ("w", 0, 1, 2, 7)], "world string, src int, dst int, ord int, count int")
    r = spark.createDataFrame([("w", 0, 1, 9, 6)], "world string, src int, dst int, ord int, count int")
    rows = c.match_messages(s, r).orderBy("n").collect()
    assert [(x.copied, x.status) for x in rows] == [(5, "matched"), (None, "unreceived")]


def test_maxloc_ties(spark):
    df = ranked(spark, 3, 1, lambda r, s: 7)
    assert c.reduce(df, "maxloc").first().loc == 0
    assert c.reduce(df, "minloc").first().loc == 0
    with pytest.raises(ValueError):
        c.reduce(df, "mean")


def test_products_are_exact_and_scan(spark):
    df = ranked(spark, 2, 1, lambda r, s: (3037000501, 3000000019)[r])
    assert c.reduce(df, "prod").first().value == 3037000501 * 3000000019
    assert values(c.scan(ranked(spark, 4, 1, lambda r, s: (-3, -1, 5, 0)[r]), "prod"), "rank") == [-3, 3, 15, 0]


def test_variable_blocks_and_user_reduction(spark):
    df = ranked(spark, 3, 4, lambda r, s: 10 * r + s)
    counts = spark.createDataFrame([("w", 0, 1), ("w", 1, 2), ("w", 2, 1)], "world string, rank int, count long")
    out = c.reduce_scatter(df, counts)[0].orderBy("rank", "slot").collect()
    assert [(r.rank, r.slot, r.value) for r in out] == [(0, 0, 30), (1, 0, 33), (1, 1, 36), (2, 0, 39)]
    assert values(c.reduce_with(df, lambda a, x: 2 * a + x, 0.0), "slot") == [40, 47, 54, 61]
    assert c.allgatherv(df, c.ranks_of(df).withColumn("count", F.lit(4).cast("long"))).count() == 36
