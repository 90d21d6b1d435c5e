"""Exact products with a constant state, unsigned bits, partial combination, and intervals of any length."""

import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftloom.functions.folds import UNSIGNED, product, unsigned_bits, unsigned_xor
from driftloom.operators import collectives as c
from driftloom.operators import diffmerge as d
from driftloom.operators.intervals import FAN, cover, in_ranges
from driftloom.operators.ordering import combine

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def test_products_are_exact_up_to_64_bits(spark):
    rng, rows, want = random.Random(1), [], {}
    special = [[LEAST, 1], [1 << 62, -2], [MOST, -1, -1], [3037000499, 3037000499], [None], [None, 7], [0, 1 << 62, 1 << 62], [-1] * 5, [1], [3, 715827882, 4294967298 // 2, 1]]
    for g in range(300):
        factors, p = [], 1
        while g >= len(special):
            x = rng.choice([rng.randrange(-3, 4), rng.randrange(-100, 100), 2 ** rng.randrange(40), rng.randrange(-(2 ** rng.randrange(1, 60)), 2 ** rng.randrange(1, 60))]) or 1
            if not LEAST <= p * x <= MOST or len(factors) > 80:
                break
            p, factors = p * x, [*factors, x]
        factors = special[g] if g < len(special) else factors
        known = [f for f in factors if f is not None]
        p = 1
        for f in known:
            p *= f
        if LEAST <= p <= MOST or 0 in known:
            want[g] = p if known else None
            rows += [(g, i, f) for i, f in enumerate(factors)]
    want = {g: p for g, p in want.items() if any(r[0] == g for r in rows)}
    df = spark.createDataFrame(rows, "g int, i int, x long").repartition(4).cache()
    assert {r.g: r.p for r in df.groupBy("g").agg(product(F.col("x"), T.LongType()).alias("p")).collect()} == want
    over = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    assert {r.g: r.p for r in df.withColumn("p", product(F.col("x"), T.LongType(), over)).select("g", "p").distinct().collect()} == want


@pytest.mark.parametrize("factors", [[1 << 62, 2], [3037000500, 3037000500], [LEAST, -1], [1 << 40] * 30])
def test_products_beyond_64_bits_are_errors(spark, factors):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(x,) for x in factors], "x long").agg(product(F.col("x"), T.LongType())).collect()


def test_ten_million_factors_in_a_constant_state(spark):
    x = F.when(F.col("id") % 2 == 0, 1).when(F.col("id") < 60, 2).otherwise(-1).cast("long")
    rows = spark.range(10_000_000).select(x.alias("x"))
    plan = rows.agg(product(F.col("x"), T.LongType()).alias("p"))
    assert plan.first().p == 2**30 * (-1) ** (5_000_000 - 30)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    assert rows.union(spark.range(1).select(F.lit(0).cast("long"))).union(rows.select(F.lit(1 << 62).cast("long")).limit(9)).agg(product(F.col("x"), T.LongType())).first()[0] == 0


def test_unsigned_bits(spark):
    rng = random.Random(2)
    rows = [(g, Decimal(rng.randrange(1 << 64))) for g in range(20) for _ in range(5)] + [(20, Decimal((1 << 64) - 1)), (21, None), (21, Decimal(1 << 63))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("g", T.LongType()), T.StructField("x", UNSIGNED)]))
    by = {g: [int(x) for k, x in rows if k == g and x is not None] for g in range(22)}
    fold = lambda f, xs: xs[0] if len(xs) == 1 else f(xs[0], fold(f, xs[1:]))
    for how, f in ((F.bit_and, int.__and__), (F.bit_or, int.__or__), (F.bit_xor, int.__xor__)):
        assert {r.g: int(r.v) for r in df.groupBy("g").agg(unsigned_bits(how, F.col("x")).alias("v")).collect()} == {g: fold(f, xs) for g, xs in by.items()}
    pairs = df.filter("x is not null").select(unsigned_xor(F.col("x"), F.lit(Decimal((1 << 64) - 1)).cast(UNSIGNED)).alias("v"), "x").collect()
    assert all(int(r.v) == int(r.x) ^ ((1 << 64) - 1) for r in pairs)
    cells = df.filter("g < 20").select(F.lit("d").alias("dataset"), F.col("g").alias("slot"), F.col("x").alias("value")).dropDuplicates(["slot"])
    diffs = cells.withColumns({"op": F.lit("xor"), "delta": F.lit(Decimal(5)).cast(UNSIGNED), "worker": F.lit(1), "seq": F.lit(1)}).drop("value")
    once = d.apply_diffs(cells, d.fold_by_op(diffs).drop("n_diffs"))
    assert d.apply_diffs(once, d.fold_by_op(diffs).drop("n_diffs")).exceptAll(cells).isEmpty() and not once.exceptAll(cells).isEmpty()


@pytest.mark.parametrize("commute", [True, False])
def test_associative_functions_are_combined_in_parts(spark, commute):
    rng = random.Random(3)
    rows = [("w" if rng.random() < 0.9 else None, rng.randrange(3), i, rng.choice([None, f"{i},"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "world string, slot long, rank int, value string").repartition(6)
    out = c.combine_with(df, lambda a, b: a + b, "string", commute=commute).collect()
    want = {}
    for w, s, _, v in rows:
        if v is not None:
            want[w, s] = want.get((w, s), "") + v
    found = {(r.world, r.slot): r.value for r in out}
    same = (lambda t: sorted(t.split(","))) if commute else (lambda t: t)
    assert {k: same(v) for k, v in found.items()} == {k: same(v) for k, v in want.items()}
    few = combine(df.select("world", F.lit(1).cast("long").alias("value")), ["world"], "value", lambda a, b: a + b, "world string, value long", held=1).collect()
    assert sum(r.value for r in few) == 2000


@pytest.mark.parametrize("page", [1, 4, 4096])
def test_covers_are_exact_and_short(spark, page):
    rng, ranges = random.Random(page), [(0, 1), (5, 5), (7, 3), (0, 64), (63, 65), (0, 64 * 64), (1, 64 * 64 * 64 - 1), (4095, 4097), (0, 100_000_000_000), (123_456_789, 98_765_432_109)]
    for _ in range(40):
        a = rng.randrange(1 << rng.randrange(1, 40))
        ranges.append((a, a + rng.randrange(1 << rng.randrange(1, 40))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "i int, lo long, hi long")
    blocks = {}
    for r in cover(df, page).collect():
        size = page * FAN**r._level
        blocks.setdefault(r.i, []).append((r._block * size, (r._block + 1) * size))
    for i, (a, b) in enumerate(ranges):
        spans = sorted(blocks.get(i, []))
        assert len(spans) <= 2 * FAN * 9 and (a >= b) == (not spans)
        if spans:
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] <= a < spans[0][0] + page * FAN**9 and spans[-1][1] >= b
            assert a - spans[0][0] < page and spans[-1][1] - b < page


def test_long_ranges_join_like_plain_loops(spark):
    rng = random.Random(8)
    ranges = [("a", 0, 100_000_000_000, 0), ("a", 17, 40, 1), ("b", 4096, 4096 * 65, 2), ("b", 4000, 1 << 45, 3), ("c", 9, 9, 4)]
    slots = [("abcd"[rng.randrange(4)], rng.choice([rng.randrange(60), rng.randrange(1 << 20), rng.randrange(1 << 50)])) for _ in range(500)]
    left = spark.createDataFrame(slots, "k string, slot long").withColumn("id", F.monotonically_increasing_id())
    right = spark.createDataFrame(ranges, "k string, lo long, hi long, n int")
    got = sorted((r.k, r.slot, r.n) for r in in_ranges(left, right, ["k"]).collect())
    assert got == sorted((k, s, n) for k, s in slots for k2, a, b, n in ranges if k == k2 and a <= s < b)
    held = {(k, s) for k, s, _ in got}
    assert sorted((r.k, r.slot) for r in in_ranges(left, right, ["k"], how="left_anti").collect()) == sorted(x for x in slots if x not in held)
    assert sorted((r.k, r.slot) for r in in_ranges(left, right, ["k"], how="left_semi").collect()) == sorted(x for x in slots if x in held)
    assert in_ranges(left, right.filter("n > 9"), ["k"]).isEmpty() and in_ranges(left, right.filter("n > 9"), ["k"], how="left_anti").count() == 500


def test_a_region_over_a_hundred_thousand_million_slots(spark):
    big = 100_000_000_000
    base = spark.createDataFrame([("d", 0, 1), ("d", 5, 1), ("d", big // 2, 1), ("d", big - 1, 1)], "dataset string, slot long, value long")
    new = base.withColumns({"worker": F.lit(0), "value": F.col("value") + 2})
    regions = spark.createDataFrame([("d", 1, 0, "sum"), ("d", 0, 1, "ignore")], "dataset string, lo long, len long, op string")
    cells, bad = d.fork_join(base, new.unionByName(new.withColumn("worker", F.lit(1))), regions)
    assert {r.slot: r.value for r in cells.collect()} == {0: 1, 5: 5, big // 2: 5, big - 1: 5} and bad.isEmpty()
