"""Exact cases of keyed state."""

import random

from pyspark.sql import functions as F

from driftloom.operators import state as k


def test_dirty_ranges_and_partial_push(spark):
    cells = lambda v: spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "key string, slot long, item int")
    local, remote, dirty = [0] * 20, [0] * 20, []
    for at, data in ((1, [1, 2, 3]), (10, [4, 5]), (14, [7, 7, 7, 7])):
        local[at : at + len(data)] = data
        dirty += range(at, at + len(data))
    for at, data in ((6, [2, 2]), (0, [6, 6, 6, 6, 6])):
        remote[at : at + len(data)] = data
    flags = spark.createDataFrame([("a", s) for s in dirty], "key string, slot long")
    assert sorted((r.offset, r.length) for r in k.dirty_ranges(flags).collect()) == [(1, 3), (10, 2), (14, 4)]
    out = k.push_partial(cells(remote), cells(local), flags).orderBy("slot").collect()
    assert [r.item for r in out] == [6, 1, 2, 3, 6, 0, 2, 2, 0, 0, 4, 5, 0, 0, 7, 7, 7, 7, 0, 0]


def test_masked_push(spark):
    cells = lambda v: spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "key string, slot long, item double")
    mask = spark.createDataFrame([("a", i, i in (1, 3)) for i in range(4)], "key string, slot long, on boolean")
    remote, local = cells([1.2345, 12.345, 987.6543, 10987654.3]), cells([1.2345, 11.11, 222.222, 3333.3333])
    out, bad = k.push_masked(remote, local, mask)
    assert [r.item for r in out.orderBy("slot").collect()] == [1.2345, 11.11, 987.6543, 3333.3333] and bad.isEmpty()
    out, bad = k.push_masked(remote, local, mask.filter("slot < 3"))
    assert [r.item for r in out.orderBy("slot").collect()] == [1.2345, 12.345, 987.6543, 10987654.3] and bad.count() == 1


def test_appends(spark):
    rows = [(1, "a", "append", "01234"), (2, "a", "append", "56"), (3, "a", "append", "56"), (4, "a", "append", "654321"), (5, "a", "clear", None), (6, "a", "append", "56"), (7, "a", "append", "654321")]
    ops = spark.createDataFrame(rows, "seq long, key string, op string, value string")
    assert k.first_appended(ops.filter("op = 'append' and seq < 5"), 4).first().value == "012345656654321"
    assert k.first_appended(k.live_appends(ops), 4).first().value == "56654321"


def test_sets(spark):
    rows = [("x", v) for v in ("123.45.67.8", "123.45.67.9", "val_c")] + [("y", v) for v in ("val_c", "val_d")] + [("p", v) for v in "abc"] + [("q", v) for v in "acde"]
    members = spark.createDataFrame(rows, "key string, member string")
    pairs = spark.createDataFrame([("x", "y"), ("p", "q"), ("p", "none"), ("none", "p")], "a string, b string")
    diff = {(r.a, r.b, r.member) for r in k.set_difference(members, pairs).collect()}
    assert {d for d in diff if d[0] == "x"} == {("x", "y", "123.45.67.8"), ("x", "y", "123.45.67.9")} and ("p", "none", "a") in diff
    assert {(r.a, r.b, r.member) for r in k.set_intersection(members, pairs).collect()} == {("x", "y", "val_c"), ("p", "q", "a"), ("p", "q", "c")}


def test_lists(spark):
    items = ["aaa", "bbbbb 123 BBBB bb", "   cccc    9999  ", "  dd    "]
    ops = spark.createDataFrame([(i, "l", "rpush", v) for i, v in enumerate(items)] + [(9, "l", "lpush", "first")], "seq long, key string, op string, value string")
    assert [r.value for r in k.list_items(ops).orderBy("position").collect()] == ["first", *items]


def test_queue_replay_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(q, s, rng.choice(["enqueue", "dequeue", "dequeue"])) for q in range(5) for s in range(200)]
    expected = []
    for q in range(5):
        waiting = []
        for _, s, op in (r for r in rows if r[0] == q):
            if op == "enqueue":
                waiting.append(s)
            else:
                expected.append((q, s, waiting.pop(0) if waiting else None))
    out = k.replay_queues(spark.createDataFrame(rows, "queue long, seq long, op string"))
    assert sorted(map(str, map(tuple, out.select("queue", "seq", "item_seq").collect()))) == sorted(map(str, expected))


def test_patches_and_rejects(spark):
    values = spark.createDataFrame([("a", "......", 1)], "key string, value string, seq long")
    patches = spark.createDataFrame([("a", 2, 0, "xy"), ("a", 3, 1, "z"), ("a", 4, 5, "qq"), ("b", 5, 0, "q"), ("a", 0, 3, "old")], "key string, seq long, offset long, data string")
    cells, bad = k.patch_cells(values, patches)
    assert k.assemble(cells).first().value == "xz...."
    assert sorted(r.seq for r in bad.collect()) == [4, 5]


def test_chunks_and_ranges(spark):
    values = spark.createDataFrame([("a", bytes(range(10))), ("e", b"")], "key string, value binary")
    chunks = k.split_chunks(values, 4).orderBy("offset").collect()
    assert [(r.offset, r.length) for r in chunks] == [(0, 4), (4, 4), (8, 2)]
    good, bad = k.read_ranges(values, spark.createDataFrame([("a", 2, 3), ("a", 8, 3), ("z", 0, 0)], "key string, offset long, len long"))
    assert bytes(good.first().data) == bytes([2, 3, 4]) and bad.count() == 2


def test_conditional_writes(spark):
    rows = [("setnx", "x", 10.0, 0.0), ("setnx", "y", None, 5.0), ("setnx", "y", None, 11.0), ("delifeq", "x", None, 12.0), ("delifeq", "y", None, 12.0), ("del", None, None, 13.0)]
    ops = spark.createDataFrame([(k, i, at, op, arg, ttl, None) for k in ("a", None) for i, (op, arg, ttl, at) in enumerate(rows)], "key string, seq long, at double, op string, arg string, ttl double, offset long")
    for key in ("key = 'a'", "key is null"):
        assert [r.done for r in k.conditional_writes(ops).filter(key).orderBy("seq").collect()] == [True, False, True, False, True, False]


def test_live_value_and_list(spark):
    rows = [("append", "p", None, None), ("set", "abcdef", None, None), ("chunk", "XY", None, 4), ("chunk", "XY", None, 5), ("append", "q", None, None), ("expire", None, 2.0, None), ("clear", None, None, None),
            ("append", "r", None, None), ("chunk", "Z", None, 0), ("bogus", None, None, None)]
    ops = spark.createDataFrame([("a", i, float(i), op, arg, ttl, at) for i, (op, arg, ttl, at) in enumerate(rows)], "key string, seq long, at double, op string, arg string, ttl double, offset long")
    out = [(r.done, r.value, r.appended) for r in k.conditional_writes(ops).orderBy("seq").collect()]
    assert out == [(True, None, 1), (True, "abcdef", 1), (True, "abcdXY", 1), (False, "abcdXY", 1), (True, "abcdXY", 2), (True, "abcdXY", 2), (True, "abcdXY", 0), (True, None, 1), (False, None, 1), (False, None, 1)]


def test_counters_start_at_zero(spark):
    ops = spark.createDataFrame([("a", "incr", None), ("a", "decrby", 5), ("b", "get", None)], "key string, op string, num long")
    assert {r.key: r.total for r in k.counters(ops).collect()} == {"a": -4, "b": 0}
    assert k.check_keys(spark.createDataFrame([("u", ""), ("u", "k")], "user string, key string"))[1].count() == 1
    assert k.random_member(spark.createDataFrame([("a", "x"), ("a", "y")], "key string, member string").withColumn("key", F.col("key"))).count() == 1
