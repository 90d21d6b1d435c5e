"""Collectives over values held by numbered ranks.

Input is `ranked(world, rank, slot, value)`: a world is a group of ranks, a slot an element of a rank's buffer.
Blocks are equal unless a counts table says otherwise. Reductions are partial and final aggregates; only the
prefix scan needs a window, and that is per (world, slot), as long as the world has ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import UNSIGNED, product, unsigned_bits
from .intervals import in_ranges
from .ordering import combine, fold_sorted, number_rows, prefix_sums

KEYS = ["world", "slot"]
#: Rows that meet all rows of a small table of their world are dealt into so many parts a world.
PARTS = 64

#: Reductions by name. maxloc and minloc give struct(value, rank), the lowest rank on ties.
OPS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "max": F.max, "min": F.min, "land": F.bool_and, "lor": F.bool_or, "band": F.bit_and, "bor": F.bit_or,
}


def ranks_of(ranked: DataFrame) -> DataFrame:
    return ranked.select("world", "rank").distinct()


def in_world(rows: DataFrame, few: DataFrame) -> DataFrame:
    """rows (world, slot, ...) joined to all rows of their world in `few`, a table of few rows a world. Slots are dealt
    into parts, each of which meets a copy of the few, so a world is not one task."""
    dealt = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("slot"), F.lit(PARTS)).cast("int")).join(dealt, ["world", "_part"]).drop("_part")


def broadcast(ranked: DataFrame, root: int = 0) -> DataFrame:
    """The root's slots at every rank of its world."""
    return in_world(ranked.filter(F.col("rank") == root).drop("rank"), ranks_of(ranked)).select("world", "rank", "slot", "value")


def scatter(buffer: DataFrame, block: int) -> DataFrame:
    """Cuts a root's buffer (world, slot, value) into blocks: block r goes to rank r."""
    return buffer.select("world", F.expr(f"slot div {block}").alias("rank"), (F.col("slot") % block).alias("slot"), "value")


def gather(ranked: DataFrame, block: int) -> DataFrame:
    """The root's buffer: rank r's slot s stands at r * block + s. The in-place form has the same result."""
    return ranked.select("world", (F.col("rank") * block + F.col("slot")).alias("slot"), "value")


def allgather(ranked: DataFrame, block: int) -> DataFrame:
    return in_world(gather(ranked, block), ranks_of(ranked)).select("world", "rank", "slot", "value")


def reduction(op: str, ranked: DataFrame, over=None) -> Column:
    """The reduction as an aggregate, or as a window function; products of whole numbers are exact."""
    if op == "prod":
        return product(F.col("value"), ranked.schema["value"].dataType, over)
    if op not in OPS:
        raise ValueError(f"unknown reduction {op}")
    if op in ("band", "bor") and ranked.schema["value"].dataType == UNSIGNED:
        at = lambda c: c if over is None else c.over(over)
        return unsigned_bits(lambda c: at(OPS[op](c)), F.col("value"))
    return OPS[op](F.col("value")) if over is None else OPS[op](F.col("value")).over(over)


def reduce(ranked: DataFrame, op: str = "sum") -> DataFrame:
    """Element-wise reduction over ranks: (world, slot, value). Integer sums keep the input type."""
    if op in ("maxloc", "minloc"):
        by = F.struct("value", (-F.col("rank") if op == "maxloc" else F.col("rank")).alias("r"))
        best = (F.max if op == "maxloc" else F.min)(by)
        out = ranked.groupBy(KEYS).agg(best.alias("best"))
        return out.select(*KEYS, F.col("best.value").alias("value"), F.abs("best.r").alias("loc"))
    return ranked.groupBy(KEYS).agg(reduction(op, ranked).cast(ranked.schema["value"].dataType).alias("value"))


def allreduce(ranked: DataFrame, op: str = "sum") -> DataFrame:
    """The reduction at every rank that holds the slot."""
    return ranked.select("world", "rank", "slot").join(reduce(ranked, op), KEYS)


def scan(ranked: DataFrame, op: str = "sum") -> DataFrame:
    """Inclusive prefix reduction over ranks, each slot apart."""
    upto = Window.partitionBy(*KEYS).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("value", reduction(op, ranked, upto).cast(ranked.schema["value"].dataType))


def all_to_all(ranked: DataFrame, block: int) -> DataFrame:
    """Block j of rank i becomes block i of rank j: a projection."""
    return ranked.select(
        "world", F.expr(f"slot div {block}").cast(ranked.schema["rank"].dataType).alias("rank"),
        (F.col("rank") * block + F.col("slot") % block).cast("long").alias("slot"), "value")


def match_messages(sends: DataFrame, recvs: DataFrame) -> DataFrame:
    """Matches the n-th send of each (world, src, dst) channel to its n-th receive (order column `ord`).

    Result: channel, n, send_count, recv_count, copied = least of both, status matched, unreceived or unsent."""
    channel = ["world", "src", "dst"]
    s = number_rows(sends, channel, ["ord"], "n").select(*channel, "n", F.col("count").alias("send_count"))
    r = number_rows(recvs, channel, ["ord"], "n").select(*channel, "n", F.col("count").alias("recv_count"))
    status = F.when(F.col("recv_count").isNull(), "unreceived").when(F.col("send_count").isNull(), "unsent").otherwise("matched")
    return s.join(r, [*channel, "n"], "full").select(
        *channel, "n", "send_count", "recv_count", F.when(status == "matched", F.least("send_count", "recv_count")).alias("copied"), status.alias("status"))


def ring_shift(ranked: DataFrame, sizes: DataFrame, by: int = 1) -> DataFrame:
    """Every rank sends its buffer to rank + by and receives that of rank - by, around the world (world, size)."""
    rank = F.pmod(F.col("rank") + by, F.col("size")).cast(ranked.schema["rank"].dataType)
    return in_world(ranked, sizes).select("world", rank.alias("rank"), "slot", "value")


def grid_coords(ranks: DataFrame) -> DataFrame:
    """(world, rank, size, d0, d1) plus coordinates c0, c1, c2; `valid` is false where d0 * d1 is not the size."""
    return ranks.withColumns({
        "c0": F.expr("rank div d1").cast("int"), "c1": (F.col("rank") % F.col("d1")).cast("int"), "c2": F.lit(0),
        "valid": F.col("d0") * F.col("d1") == F.col("size"),
    })


def grid_rank(coords: DataFrame) -> DataFrame:
    return coords.withColumn("rank", (F.col("c0") * F.col("d1") + F.col("c1")).cast("int"))


def grid_shift(ranks: DataFrame, axis: int, by: int = 1) -> DataFrame:
    """Adds source and dest: the neighbours at -by and +by along the axis, around the grid; a rank itself beyond
    the second axis."""
    at = grid_coords(ranks)
    if axis == 0:
        near = lambda d: F.pmod(F.col("c0") + d, F.col("d0")) * F.col("d1") + F.col("c1")
    elif axis == 1:
        near = lambda d: F.col("c0") * F.col("d1") + F.pmod(F.col("c1") + d, F.col("d1"))
    else:
        near = lambda d: F.col("rank")
    return at.withColumns({"source": near(-by).cast("int"), "dest": near(by).cast("int")})


def exchange_counts(rank_hosts: DataFrame, root: int, kind: str) -> DataFrame:
    """Messages that each rank sends in a two-level exchange: (world, rank, local, remote), for gather also `blocks`, the
    ranks' blocks in the rank's message.

    The leader of a host is its lowest rank. broadcast: the root sends to the other ranks of its host and to the
    other leaders, and these to the ranks of their hosts. reduce and gather: ranks send to their leader (to the
    root on its host), leaders to the root. alltoall: each rank to every other one."""
    hosts = rank_hosts.groupBy("world", "host").agg(F.min("rank").alias("leader"), F.count("*").alias("n"))
    worlds = hosts.groupBy("world").agg(F.sum("n").alias("size"), F.count("*").alias("n_hosts"))
    home = rank_hosts.filter(F.col("rank") == root).select("world", F.col("host").alias("home"))
    df = rank_hosts.join(hosts, ["world", "host"]).join(worlds, "world").join(home, "world")
    is_root, at_home, leads = F.col("rank") == root, F.col("host") == F.col("home"), F.col("rank") == F.col("leader")
    zero = F.lit(0)
    if kind == "broadcast":
        local = F.when(is_root, F.col("n") - 1).when(leads & ~at_home, F.col("n") - 1).otherwise(zero)
        remote = F.when(is_root, F.col("n_hosts") - 1).otherwise(zero)
    elif kind in ("reduce", "gather"):
        local = F.when(is_root, zero).when(at_home | ~leads, 1).otherwise(zero)
        remote = F.when(~at_home & leads, 1).otherwise(zero)
    elif kind == "alltoall":
        local, remote = F.col("n") - 1, F.col("size") - F.col("n")
    else:
        raise ValueError(f"unknown exchange {kind}")
    counts = df.select("world", "rank", local.cast("long").alias("local"), remote.cast("long").alias("remote"), F.when(is_root, zero).when(leads & ~at_home, F.col("n")).otherwise(1).cast("long").alias("blocks"))
    return counts if kind == "gather" else counts.drop("blocks")


def offsets(counts: DataFrame) -> DataFrame:
    """(world, rank, count) plus offset: the sum of the counts of lower ranks."""
    return prefix_sums(counts, ["world"], ["rank"], "count", "offset")


def gatherv(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """Variable-block gather: rank r's slot s stands at offset(r) + s."""
    return ranked.join(offsets(counts), ["world", "rank"]).select("world", (F.col("offset") + F.col("slot")).alias("slot"), "value")


def allgatherv(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    return in_world(gatherv(ranked, counts), counts.select("world", "rank")).select("world", "rank", "slot", "value")


def reduce_scatter(ranked: DataFrame, counts: DataFrame, op: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): reduces, then gives rank r the slots [offset(r), offset(r) + count(r)). Reduced slots (world,
    slot, value) that no rank's count covers are rejects."""
    ranges = offsets(counts).select("world", "rank", F.col("offset").alias("lo"), (F.col("offset") + F.col("count")).alias("hi"))
    whole = reduce(ranked, op)
    cells = in_ranges(whole, ranges, ["world"]).select("world", "rank", (F.col("slot") - F.col("lo")).alias("slot"), "value")
    return cells, _beyond(whole, counts, ["world"])


def _beyond(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose slot is not below the sum of the counts of their keys."""
    total = counts.groupBy(keys).agg(F.sum("count").alias("_total"))
    return rows.join(total, keys, "left").filter((F.col("slot") < 0) | (F.col("slot") >= F.coalesce("_total", F.lit(0)))).drop("_total").select(rows.columns)


def all_to_allv(ranked: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) of a variable-block all-to-all. counts: (world, src, dst, count); a rank's buffer holds its blocks
    by dst, and receives blocks by src. Slots beyond a rank's blocks (world, rank, slot, value) are rejects."""
    send = Window.partitionBy("world", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    recv = Window.partitionBy("world", "dst").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumns({"s": F.coalesce(F.sum("count").over(send), F.lit(0)), "r": F.coalesce(F.sum("count").over(recv), F.lit(0))})
    ranges = at.select("world", F.col("src").alias("rank"), "dst", "r", F.col("s").alias("lo"), (F.col("s") + F.col("count")).alias("hi"))
    held = in_ranges(ranked, ranges, ["world", "rank"])
    cells = held.select("world", F.col("dst").alias("rank"), (F.col("r") + F.col("slot") - F.col("lo")).cast("long").alias("slot"), "value")
    return cells, _beyond(ranked, counts.withColumnRenamed("src", "rank"), ["world", "rank"])


def split_world(ranks: DataFrame) -> DataFrame:
    """(world, rank, color, key) plus new_rank, from 0 per (world, color), by key and then rank."""
    return number_rows(ranks, ["world", "color"], ["key", "rank"], "new_rank").withColumn("new_rank", F.col("new_rank").cast("int"))


def reduce_with(ranked: DataFrame, step: Callable, start, value_type: str = "double") -> DataFrame:
    """User-defined reduction: step(so far, value) in rank order per (world, slot), from `start`. The ranks of a slot
    come as a stream, so they are never held together."""

    def fold(key: tuple, rows):
        out = start
        for _, value in rows:
            out = step(out, value)
        yield *key, out

    world = ranked.schema["world"].dataType.simpleString()
    return fold_sorted(ranked.select("world", F.col("slot").cast("long").alias("slot"), "rank", "value"), KEYS, ["rank"], fold, f"world {world}, slot long, value {value_type}")


def combine_with(ranked: DataFrame, function: Callable, value_type: str = "double", commute: bool = True) -> DataFrame:
    """(world, slot, value) by an associative function of two values. What a task holds of a slot is combined there, so
    partial results are shuffled instead of values; in order of ranks unless it commutes, in any order if it does."""
    world = ranked.schema["world"].dataType.simpleString()
    rows = ranked.select("world", F.col("slot").cast("long").alias("slot"), "rank", "value")
    return combine(rows, KEYS, "value", function, f"world {world}, slot long, value {value_type}", order=None if commute else ["rank"])
