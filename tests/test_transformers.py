"""Ranges of logs as functions of the state before: equal to running them, from any state, however they are cut."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.operators import state as k
from driftloom.operators.transformers import Balance, KeyLog

VALUES = ["a", "b", "ab", "abc"]
STEP = st.tuples(st.sampled_from(["set", "setnx", "setnx", "del", "delifeq", "delifeq", "expire", "append", "clear", "chunk", "odd"]), st.sampled_from([*VALUES, None]),
                 st.sampled_from([None, None, 1.0, 3.0, 8.0, float("nan")]), st.sampled_from([0, 1, 2, None, -1]))


def plain(rows, state, n):
    value, ends = state or (None, None)
    for row, _, value, ends in k.fold_key(((i, *r) for i, r in enumerate(rows)), value, ends):
        n = n + 1 if row[2] == "append" else 0 if row[2] == "clear" else n
    return (None if value is None else (value, ends)), n


def dead_at(state, t):
    """A value whose time is over when the next operation comes counts as none."""
    return None if state and state[1] is not None and t >= state[1] else state


@settings(max_examples=1500, deadline=None)
@given(st.lists(STEP, max_size=25), st.lists(st.floats(0, 3, width=16), min_size=25, max_size=25), st.booleans(), st.sampled_from([None, *VALUES]), st.sampled_from([None, 0.5, 2.0, 5.0, 20.0]))
def test_a_range_is_a_function_of_the_state_before(steps, gaps, ordered, value, ends):
    now, rows = 0.0, []
    for (op, arg, ttl, offset), gap in zip(steps, gaps):
        now = now + gap if ordered else gap * 7
        rows.append((now, op, arg, ttl, offset))
    start = None if value is None else (value, ends)
    want, n = plain(rows, start, 5)
    got, m = KeyLog(rows).apply((start, 5))
    late = max((r[0] for r in rows[-1:]), default=float("-inf"))
    assert (dead_at(got, late), m) == (dead_at(want, late), n)


@given(st.lists(st.sampled_from([1, -1]), max_size=40), st.integers(0, 5))
def test_balance(steps, held):
    came, gone, now = 7, 7 - held, held
    for s in steps:
        if s > 0:
            now, came = now + 1, came + 1
        elif now:
            now, gone = now - 1, gone + 1
    assert Balance(steps).apply((held, 7, 7 - held)) == (now, came, gone)


@pytest.fixture
def ranges(spark):
    """Small inputs are dealt into ranges as large ones are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def log(n, share=0.9):
    rng = random.Random(n)
    ops = ["setnx", "delifeq", "expire", "append", "clear", "chunk", "del"]
    return [(1 if rng.random() < share else rng.choice([2, 3, None]), i, float(i), rng.choices(ops, [8, 3, 3, 5, 1, 1, 1])[0], rng.choice(VALUES), rng.choice([None, 2.0, 30.0]), rng.choice([0, 1, None])) for i in range(n)]


def test_one_key_with_most_of_a_log_and_no_set(spark, ranges):
    rows = log(4000)
    df = spark.createDataFrame(rows, "key long, seq long, at double, op string, arg string, ttl double, offset int").repartition(5)
    want = []
    for key in (1, 2, 3, None):
        n = 0
        for row, done, value, _ in k.fold_key(r[1:] for r in rows if r[0] == key):
            n = n + 1 if row[2] == "append" else 0 if row[2] == "clear" else n
            want.append((key, row[0], done, value, n))
    out = k.conditional_writes(df)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    spread = out.filter("key = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.7 * 4000
    assert k.conditional_writes(df.filter("seq < 0")).collect() == []


@pytest.mark.parametrize("share", [0.4, 0.6])
def test_one_hot_queue(spark, ranges, share):
    rng, rows = random.Random(4), []
    for i in range(3000):
        rows.append(("q" if rng.random() < 0.9 else None, i, "enqueue" if rng.random() < share else "dequeue"))
    queues, want = {}, []
    for q, i, op in rows:
        held = queues.setdefault(q, [])
        if op == "enqueue":
            held.append(i)
        else:
            want.append((q, i, held.pop(0) if held else None))
    out = k.replay_queues(spark.createDataFrame(rows, "queue string, seq long, op string").repartition(5))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
