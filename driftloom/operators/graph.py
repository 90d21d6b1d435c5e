"""Call graphs: trees of tasks and the tasks that they called.

`calls(app, parent_id, child_id)` are edges, `results(app, id, ...)` the finished tasks. A tree is unfolded by doubling:
jumps over 2, 4, 8 ... calls are joined from jumps of half that length, so a chain of n calls takes log n rounds. Sizes of
subtrees give each node its place in depth-first order; (level, place) is breadth-first order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ordering import running
from .results import MIGRATED

NODE = ["app", "root"]


def leading_to_cycles(calls: DataFrame) -> DataFrame:
    """(app, id) of the tasks from which a cycle of calls can be reached.

    Calls of tasks that call nothing (any more) are stripped until none is left to strip. A task with one remaining call
    skips to where that leads if the called one has one call, too, so chains shrink by half each round and a tree is
    gone in about log(tasks) rounds, however deep it is."""
    edges = cut(calls.select("app", F.col("parent_id").cast("long").alias("u"), F.col("child_id").cast("long").alias("v")).distinct())
    n = edges.count()
    while n:
        kept = edges.join(edges.select("app", F.col("u").alias("v")).distinct(), ["app", "v"], "left_semi")
        single = kept.groupBy("app", "u").agg(F.min("v").alias("w"), F.count("*").alias("n")).filter("n = 1")
        skips = single.select("app", F.col("u").alias("v"), "w")
        counted = kept.join(single.select("app", "u", F.lit(True).alias("_one")), ["app", "u"], "left")
        left = cut(counted.join(skips, ["app", "v"], "left").select("app", "u", F.when(F.col("_one"), F.coalesce("w", "v")).otherwise(F.col("v")).alias("v")).distinct())
        before, n, edges = n, left.count(), left
        if n == before:
            break
    return edges.select("app", F.col("u").alias("id")).distinct()


def cycle_nodes(calls: DataFrame) -> DataFrame:
    """(app, id) of the tasks that lie on cycles of calls, or between two cycles."""
    held = cut(leading_to_cycles(calls))
    ends = [held.withColumnRenamed("id", c) for c in ("parent_id", "child_id")]
    inner = calls.join(ends[0], ["app", "parent_id"], "left_semi").join(ends[1], ["app", "child_id"], "left_semi")
    return leading_to_cycles(inner.select("app", F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id")))


def _refuse_cycles(roots: DataFrame, calls: DataFrame) -> DataFrame:
    """The calls without those that lead to cycles; an error if a root leads to one. Where each call goes to a larger
    number there is no cycle and nothing to strip."""
    if calls.filter("child_id <= parent_id").isEmpty():
        return calls
    bad = cut(leading_to_cycles(calls))
    if bad.isEmpty():
        return calls
    met = roots.join(bad.withColumnRenamed("id", "root"), NODE, "left_semi").select("app").distinct()
    if not met.isEmpty():
        named = cycle_nodes(calls.join(met, "app", "left_semi")).orderBy("app", "id").limit(10).collect()
        raise ValueError("calls lead back to their callers, at " + ", ".join(f"task {r.id} of app {r.app}" for r in named))
    return calls.join(bad.withColumnRenamed("id", "parent_id"), ["app", "parent_id"], "left_anti")


def subtree_sizes(calls: DataFrame) -> DataFrame:
    """(app, id, size): how many nodes the tree under each caller unfolds to, itself among them; a task that calls
    nothing has 1. Rows (u, v, n) are n paths of 1, 2, 4 ... calls, rows (u, null, n) the nodes nearer than that."""
    edge = calls.select("app", F.col("parent_id").alias("u"), F.col("child_id").alias("v"), F.lit(1).cast("long").alias("n"))
    nodes = edge.select("app", "u").union(edge.select("app", "v")).distinct().select("app", "u", F.lit(None).cast("long").alias("v"), F.lit(1).cast("long").alias("n"))
    now = cut(edge.union(nodes))
    while not now.filter("v is not null").isEmpty():
        further = now.filter("v is not null").join(now.select("app", F.col("u").alias("v"), F.col("v").alias("w"), F.col("n").alias("m")), ["app", "v"])
        rows = further.select("app", "u", F.col("w").alias("v"), (F.col("n") * F.col("m")).alias("n")).union(now.filter("v is null"))
        now = cut(rows.groupBy("app", "u", "v").agg(F.sum("n").alias("n")))
    return now.select("app", F.col("u").alias("id"), F.col("n").alias("size"))


def call_trees(roots: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes (app, root, id, parent_id, level, place, size, nth) of the trees from roots (app, root): place counts the
    tree's nodes depth first from 0, size the nodes from this one down, nth the calls of the parent from 0.

    Children are unique per parent, so a task under two parents stands twice. A tree with any node that has no result is
    empty. Calls that lead back to a caller are an error that names them, before anything is unfolded."""
    edges = cut(calls.select("app", F.col("parent_id").cast("long").alias("parent_id"), F.col("child_id").cast("long").alias("child_id")).distinct())
    edges = _refuse_cycles(roots, edges)
    sizes = subtree_sizes(edges)
    sized = edges.join(sizes.withColumnRenamed("id", "child_id"), ["app", "child_id"])
    sized = running(sized, ["app", "parent_id"], ["child_id"], {"_before": ("sum", "size"), "nth": ("sum", F.lit(1).cast("long"))}, inclusive=False)
    columns = ["app", "root", "u", "id", "parent_id", "level", "place", "size", "nth"]
    jumps = sized.select("app", F.lit(None).cast("long").alias("root"), F.col("parent_id").alias("u"), F.col("child_id").alias("id"), "parent_id",
                         F.lit(1).alias("level"), (F.col("_before") + 1).alias("place"), "size", "nth")
    top = roots.select("app", F.col("root").cast("long").alias("root")).join(sizes.withColumnRenamed("id", "root"), NODE, "left")
    trees = top.select("app", "root", F.lit(None).cast("long").alias("u"), F.col("root").alias("id"), F.lit(None).cast("long").alias("parent_id"),
                       F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.coalesce("size", F.lit(1)).alias("size"), F.lit(0).cast("long").alias("nth"))
    first = cut(jumps.union(trees))
    jumps, levels = first.filter("u is not null"), [first.filter("u is null")]
    while True:
        from_ = reduce(DataFrame.union, levels).union(jumps).select("app", "root", "u", F.col("id").alias("_at"), F.col("level").alias("_l"), F.col("place").alias("_p"))
        to = jumps.select("app", F.col("u").alias("_at"), "id", "parent_id", "level", "place", "size", "nth")
        made = cut(from_.join(to, ["app", "_at"]).withColumns({"level": F.col("level") + F.col("_l"), "place": F.col("place") + F.col("_p")}).select(columns))
        down = made.filter("u is null")
        if down.isEmpty():
            break
        levels.append(down)
        jumps = made.filter("u is not null")
    nodes = reduce(DataFrame.union, levels).drop("u")
    missing = nodes.join(results.select("app", "id"), ["app", "id"], "left_anti").select(*NODE).distinct()
    return nodes.join(missing, NODE, "left_anti")


def node_counts(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app, root, nodes); the empty graph counts 1."""
    return roots.join(nodes.groupBy(NODE).agg(F.count("*").alias("nodes")), NODE, "left").select(*NODE, F.coalesce("nodes", F.lit(1)).cast("long").alias("nodes"))


def tree_hosts(nodes: DataFrame, results: DataFrame) -> DataFrame:
    return nodes.join(results.select("app", "id", "host"), ["app", "id"]).groupBy(NODE).agg(F.sort_array(F.collect_set("host")).alias("hosts"))


def rank_hosts(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """(app, root, rank, host): the last node of each rank in depth-first order."""
    return nodes.join(results.select("app", "id", "host", "rank"), ["app", "id"]).groupBy(*NODE, "rank").agg(F.max_by("host", "place").alias("host"))


def migrated_rank_hosts(nodes: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((app, root, rank, before, after), rejects): in breadth-first order the last migrated node of a rank, else its
    first success, is where it was before, and its last success where it was after. Other codes are rejects."""
    rows = nodes.join(results.select("app", "id", "host", "rank", "return_value"), ["app", "id"]).withColumn("_at", F.struct("level", "place"))
    moved, ok = F.col("return_value") == MIGRATED, F.col("return_value") == 0
    last_moved = F.max_by(F.when(moved, F.col("host")), F.when(moved, F.col("_at")))
    first_ok = F.min_by(F.when(ok, F.col("host")), F.when(ok, F.col("_at")))
    out = rows.filter(moved | ok).groupBy(*NODE, "rank").agg(F.coalesce(last_moved, first_ok).alias("before"), F.max_by(F.when(ok, F.col("host")), F.when(ok, F.col("_at"))).alias("after"))
    return out, rows.filter(~(moved | ok)).select(*NODE, "id", "return_value")


def children(calls: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((app, parent_id, children), rejects): children as a set; calls that are registered twice or whose child is
    unknown are rejects (app, parent_id, child_id, reason)."""
    counted = calls.groupBy("app", "parent_id", "child_id").agg(F.count("*").alias("n"))
    known = tasks.select("app", F.col("id").alias("child_id"))
    double = counted.filter("n > 1").select("app", "parent_id", "child_id", F.lit("duplicate").alias("reason"))
    unknown = counted.join(known, ["app", "child_id"], "left_anti").select("app", "parent_id", "child_id", F.lit("unknown").alias("reason"))
    good = counted.join(known, ["app", "child_id"], "left_semi").groupBy("app", "parent_id").agg(F.sort_array(F.collect_set("child_id")).alias("children"))
    return good, double.unionByName(unknown)


def details(rows: DataFrame) -> DataFrame:
    """(app, id, strings, counters) of recorded details (app, id, seq, recording, key, str_value, int_value): the last
    string and the sum of the integers of each key."""
    on = rows.filter("recording").groupBy("app", "id", "key").agg(
        F.max_by("str_value", F.when(F.col("str_value").isNotNull(), F.col("seq"))).alias("s"), F.sum("int_value").cast("long").alias("i"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("key", c)))))
    return on.groupBy("app", "id").agg(pairs("s").alias("strings"), pairs("i").alias("counters"))


def message_matrix(messages: DataFrame, types: list[str]) -> DataFrame:
    """(world, src, dst, total, one column per type): messages sent."""
    counts = messages.groupBy("world", "src", "dst").pivot("type", types).count()
    return counts.select("world", "src", "dst", *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in types]).withColumn("total", reduce(lambda a, b: a + b, [F.col(t) for t in types]))


def tree_json(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """(app, root, json): each tree as nested objects {"msg": ..., "chained": [...]}.

    A walk around the tree meets each node twice: its text stands where it is opened, the brackets where it is closed.
    The two places follow from its place, level and size, so each text is written once and a root's tokens are joined in
    one go."""
    rows = nodes.join(results.select("app", "id", F.to_json(F.struct("id", "host", "return_value")).alias("msg")), ["app", "id"])
    opened, calls_ = F.col("place") * 2 - F.col("level"), F.col("size") > 1
    head = F.concat(F.when(F.col("nth") > 0, ",").otherwise(""), F.lit('{"msg":'), "msg", F.when(calls_, ',"chained":[').otherwise("}"))
    tokens = F.array(F.struct(opened.alias("at"), head.alias("text")), F.struct((opened + F.col("size") * 2 - 1).alias("at"), F.lit("]}").alias("text")))
    walk = rows.select(*NODE, F.explode(F.when(calls_, tokens).otherwise(F.slice(tokens, 1, 1))).alias("t"))
    return walk.groupBy(NODE).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["text"]), "").alias("json"))
