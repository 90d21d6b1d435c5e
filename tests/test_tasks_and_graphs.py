"""Exact cases of results, call graphs, checks, messaging, user functions and scalar expressions."""

import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions import scalars as f
from driftloom.operators import checks as p
from driftloom.operators import graph as g
from driftloom.operators import messaging as m
from driftloom.operators import results as b
from driftloom.operators import tasks as u
from driftloom.sources import tasks as t


@pytest.fixture(scope="module")
def tree(spark):
    """A calls B1 and B2; B1 calls C1; B2 calls C2 and C3; C2 calls D."""
    calls = spark.createDataFrame([(1, a, c) for a, c in ((1, 2), (1, 3), (2, 4), (3, 5), (3, 6), (5, 7))], "app long, parent_id long, child_id long")
    rows = [(1, i, h, r, v) for i, h, r, v in ((1, "foo", 0, 0), (2, "bar", 1, b.MIGRATED), (3, "baz", 2, 0), (4, "baz", 1, 0), (5, "foo", 3, 0), (6, "bar", 4, 0), (7, "foo", 5, 0))]
    return spark.createDataFrame([(1, 1)], "app long, root long"), calls, spark.createDataFrame(rows, "app long, id long, host string, rank int, return_value int")


def test_call_tree(tree):
    roots, calls, results = tree
    nodes = g.call_trees(roots, calls, results).cache()
    assert g.node_counts(roots, nodes).first().nodes == 7
    assert g.tree_hosts(nodes, results).first().hosts == ["bar", "baz", "foo"]
    assert [r.id for r in nodes.orderBy("place").collect()] == [1, 2, 4, 3, 5, 7, 6]
    moved, bad = g.migrated_rank_hosts(nodes, results)
    assert {r.rank: (r.before, r.after) for r in moved.collect()}[1] == ("bar", "baz") and bad.isEmpty()
    text = g.tree_json(nodes, results).first().json
    assert text.startswith('{"msg":{"id":1,') and text.count('"chained"') == 4
    missing = g.call_trees(roots, calls, results.filter("id <> 7"))
    assert missing.isEmpty() and g.node_counts(roots, missing).first().nodes == 1


def edges_of(spark, pairs, app=1):
    return spark.createDataFrame([(app, a, b) for a, b in pairs], "app long, parent_id long, child_id long")


def results_of(spark, ids, app=1):
    return spark.createDataFrame([(app, i, "h", 0) for i in ids], "app long, id long, host string, return_value int")


def test_cycles_are_reported(spark, tree):
    roots, calls, results = tree
    with pytest.raises(ValueError, match="task 1 of app 1"):
        g.call_trees(roots, calls.union(edges_of(spark, [(7, 1)])), results)
    # A ring whose tasks each call two others would double its nodes with every level.
    n = 40
    branching = edges_of(spark, [(i, (i + k) % n + 1) for i in range(1, n + 1) for k in (0, 6)])
    with pytest.raises(ValueError, match="task 1 of app 1"):
        g.call_trees(roots, branching, results_of(spark, range(1, n + 1)))
    # A cycle that no root leads to is no error; nor is one of another app.
    apart = calls.union(edges_of(spark, [(90, 91), (91, 92), (92, 91), (91, 4)])).union(edges_of(spark, [(1, 1)], app=2))
    assert g.call_trees(roots, apart, results).count() == 7


@pytest.mark.parametrize("pairs,leading,on", [
    ([(1, 2), (2, 3), (3, 1)], {1, 2, 3}, {1, 2, 3}), ([(1, 2), (2, 2), (2, 3)], {1, 2}, {2}), ([(1, 2), (1, 3), (2, 4), (3, 4)], set(), set()),
    ([(i, i + 1) for i in range(1, 60)] + [(60, 30), (5, 100)], set(range(1, 61)), set(range(30, 61))), ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)], {1, 2, 3, 4}, {1, 2, 3, 4}),
])
def test_cycle_nodes(spark, pairs, leading, on):
    calls = edges_of(spark, pairs)
    assert {r.id for r in g.leading_to_cycles(calls).collect()} == leading
    assert {r.id for r in g.cycle_nodes(calls).collect()} == on


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 calls in a row, numbered against their order, so that the cycles have to be looked for."""
    n, made = 10_000, []
    calls = spark.range(1, n).select(F.lit(1).cast("long").alias("app"), (n + 1 - F.col("id")).alias("parent_id"), (n - F.col("id")).alias("child_id"))
    results = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("app"), "id", F.lit("h").alias("host"), F.lit(0).alias("return_value"))
    monkeypatch.setattr(g, "cut", lambda df, cut=g.cut: made.append(1) or cut(df))
    nodes = g.call_trees(spark.createDataFrame([(1, n)], "app long, root long"), calls, results)
    found = nodes.agg(F.count("*").alias("n"), F.max("level").alias("deep"), F.count_if(F.col("place") == F.col("level")).alias("same"), F.sum("size").alias("sizes")).first()
    assert tuple(found) == (n, n - 1, n, n * (n + 1) // 2)
    assert len(made) < 20 * 3  # fewer than 20 rounds of peeling, of sizes and of unfolding


def nested(tree_, texts, root):
    kids = ",".join(nested(tree_, texts, c) for c in sorted(tree_.get(root, ())))
    return '{"msg":' + texts(root) + (f',"chained":[{kids}]' if kids else "") + "}"


def test_places_and_json_of_random_trees(spark):
    """Unfolded graphs (some tasks have two callers) against plain recursion; a deep tree's text has linear size."""
    rng, pairs = random.Random(5), set()
    for i in range(2, 120):
        pairs |= {(rng.randrange(max(1, i - 9), i), i) for _ in range(1 + (i % 10 == 0))}
    tree_ = {}
    for a, b in pairs:
        tree_.setdefault(a, set()).add(b)
    walked = []

    def walk(i, parent, level):
        walked.append((i, parent, level))
        for c in sorted(tree_.get(i, ())):
            walk(c, i, level + 1)

    walk(1, None, 0)
    roots, results = spark.createDataFrame([(1, 1)], "app long, root long"), results_of(spark, range(1, 120))
    nodes = g.call_trees(roots, edges_of(spark, pairs), results)
    assert [(r.id, r.parent_id, r.level) for r in nodes.orderBy("place").collect()] == walked
    assert g.tree_json(nodes, results).first().json == nested(tree_, lambda i: f'{{"id":{i},"host":"h","return_value":0}}', 1)
    deep = g.tree_json(g.call_trees(roots, edges_of(spark, [(i, i + 1) for i in range(1, 1000)]), results_of(spark, range(1, 1001))), results_of(spark, range(1, 1001))).first().json
    assert len(deep) < 60 * 1000 and deep.endswith("]}" * 999)


def test_details_only_while_recording(spark):
    rows = [(1, 1, 1, False, "k", "v", 1), (1, 2, 1, True, "k", "v", 1), (1, 2, 2, True, "k", "w", 2)]
    out = g.details(spark.createDataFrame(rows, "app int, id int, seq int, recording boolean, key string, str_value string, int_value int")).collect()
    assert [(r.id, r.strings, r.counters) for r in out] == [(2, {"k": "w"}, {"k": 3})]


@pytest.mark.parametrize("change,valid", [({}, True), ({"task_app": 9}, False), ({"user": "other"}, False), ({"user": ""}, False), ({"function": ""}, False), ({"function": "other"}, True)])
def test_batch_validity(spark, change, valid):
    rows = [{"app": 1, "task_app": 1, "user": "demo", "function": "echo"} | (change if i == 2 else {}) for i in range(4)]
    tasks = spark.createDataFrame([(r["app"], r["task_app"], r["user"], r["function"]) for r in rows], "app int, task_app int, user string, function string")
    batch = spark.createDataFrame([(1, "demo", "echo"), (0, "demo", "echo"), (5, "demo", "echo")], "app int, user string, function string")
    assert {r.app: r.valid for r in p.batch_validity(batch, tasks).collect()} == {1: valid, 0: False, 5: True}


def test_finished_counts_and_registry(spark):
    events = spark.createDataFrame([(i, 1, i, b.MIGRATED if i == 3 else 0) for i in range(4)], "seq int, app int, id int, return_value int")
    assert b.finished_counts(events).first().finished == 3
    log = [(1, "h", "register", 0, 4, 0, False), (2, "h", "register", 1000, 9, 1, False), (3, "h", "register", 2000, -1, 0, True), (4, "h", "register", 9000, 7, 0, False), (5, "g", "register", 0, 2, 0, False), (6, "g", "remove", 1, 0, 0, False)]
    out = p.host_registry(spark.createDataFrame(log, "seq int, host string, op string, ts long, slots int, used int, overwrite boolean"), 5).collect()
    assert [(r.host, r.slots, r.register_ts) for r in out] == [("h", 7, 9000)]


def test_ordered_delivery(spark):
    rng = random.Random(1)
    rows = [("g", s, 1 - s, i, 0) for s in (0, 1) for i in range(300) if (s, i) != (1, 250)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r[:4], k) for k, r in enumerate(rows)], "group string, src int, dst int, seq int, arrival int")
    out, held = m.deliver(df)
    assert out.filter("src = 0").count() == 300 and out.filter("src = 1").count() == 250 and held.count() == 49
    assert all(r.ready >= r.arrival for r in out.collect())


def test_user_functions(spark):
    tasks = spark.createDataFrame([(1, i, name) for i, name in enumerate(["ok", "seven", "bad", "none"])], "app long, id long, function string")

    def bad(task):
        raise RuntimeError("went wrong")

    out = u.dispatch(tasks, {"ok": lambda t: 0, "seven": lambda t: (7, "out"), "bad": bad}).orderBy("id").collect()
    assert [(r.return_value, r.output) for r in out] == [(0, ""), (7, "out"), (1, "went wrong"), (1, "unknown function none")]
    done, calls = u.run_chained(spark.createDataFrame([(1, 5)], "app long, id long"), lambda t: (0, "", [t["id"] - 1] if t["id"] > 3 else []))
    assert sorted(r.id for r in done.collect()) == [3, 4, 5] and calls.count() == 2
    one = spark.createDataFrame([(1, 5)], "app long, id long")
    with pytest.raises(ValueError, match="more than 2 rounds"):
        u.run_chained(one, lambda t: (0, "", [t["id"] + 1]), max_rounds=2)
    with pytest.raises(ValueError, match="task 5 of app 1, task 6 of app 1, task 7 of app 1"):
        u.run_chained(one, lambda t: (0, "", [5 + (t["id"] - 4) % 3]))
    twice = u.run_chained(one, lambda t: (0, "", {5: [6, 7], 6: [8], 7: [6]}.get(t["id"], [])))[0]
    assert sorted(r.id for r in twice.collect()) == [5, 6, 6, 7, 8, 8]


def test_json_batches(spark):
    lines = ['{"appId": 1, "user": "demo", "messages": [{"id": 3, "function": "echo"}, {"id": 4, "mpi": true}]}', '{"appId": 2, "messages": [', "[]x"]
    good, bad = t.parse_batches(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.app, r.pos, r.id) for r in good.orderBy("pos").collect()] == [(1, 0, 3), (1, 1, 4)] and bad.count() == 2


def test_scalars(spark):
    c = F.col("c")
    cases = [
        (f.is_blank, "    ", True), (f.is_blank, "", True), (f.is_blank, " a", False), (lambda x: f.starts_with(x, "foo"), "foobar", True), (lambda x: f.starts_with(x, ""), "foobar", False),
        (lambda x: f.ends_with(x, "bar"), "foobar", True), (lambda x: f.ends_with(x, ""), "foobar", False), (lambda x: f.contains(x, ""), "a", True), (lambda x: f.remove_first(x, "blah"), "blah foobar", " foobar"),
        (lambda x: f.remove_first(x, "b"), "abab", "aab"), (f.is_digits, "12345", True), (f.is_digits, "", False), (f.is_digits, "1a", False), (lambda x: f.to_hex(x.cast("binary")), "ab", "6162"),
        (lambda x: f.from_hex(x).cast("string"), "616", None), (lambda x: f.list_text(F.split(x, ",")), "a,b", "[a, b]"),
        (lambda x: f.trim_zeros(F.unhex(x)), "61000062000000", b"a\0\0b"), (lambda x: F.array_join(f.command_line("cmd", x), "|"), "a  b", "cmd|a||b"),
    ]
    for fn, given, expected in cases:
        got = spark.createDataFrame([(given,)], "c string").select(fn(c).alias("x")).first().x
        assert (bytes(got) if isinstance(got, bytearray) else got) == expected, (given, got)
    assert spark.range(1).select(f.int_hex(F.lit(255))).first()[0] == "000000ff"


def test_repeated_calls_run_once(spark):
    """Four calls of one task at one depth are one run that counts four times."""
    import uuid

    from driftloom.operators import tasks as u

    def go(task):
        return 0, uuid.uuid4().hex, [1] if task["id"] > 1 else []

    roots = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, 7)], "app long, id long")
    results, calls = u.run_chained(roots, go)
    assert sorted((r.parent_id, r.child_id) for r in calls.collect()) == [(5, 1), (5, 1), (6, 1), (7, 1)]
    ones = [r.output for r in results.filter("id = 1").collect()]
    assert len(ones) == 4 and len(set(ones)) == 1


def test_dispatch_gives_plain_values(spark):
    from driftloom.operators import tasks as u

    tasks = spark.createDataFrame([(1, i, None if i % 2 else i) for i in range(200)], "app long, id long, size long")
    out = {r.id: r.output for r in u.run_tasks(tasks, lambda task: (0, repr(task["size"]))).collect()}
    assert out == {i: "None" if i % 2 else str(i) for i in range(200)}
