"""Keyed state and key-value tables rebuilt from operation logs.

A log row has a sequence number `seq`, a key and an operation. State is what the log leaves: aggregates by key
where the last or the sum decides, ordered folds per key only where each operation depends on the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diffmerge import islands
from .lineage import cut
from .ordering import number_rows, scan_ranges
from .transformers import Balance, KeyLog, lasting, patched

CHUNK = 64 * 1024


def check_keys(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): user and key must both be there and not be empty."""
    good = (F.coalesce(F.col("user"), F.lit("")) != "") & (F.coalesce(F.col("key"), F.lit("")) != "")
    return ops.filter(good), ops.filter(~good)


def set_values(ops: DataFrame) -> DataFrame:
    """(key, value, seq): the last set of each key that no later delete removes."""
    last = ops.filter(F.col("op").isin("set", "delete")).groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return last.filter("x.op = 'set'").select("key", "x.value", "x.seq")


def count_keys(values: DataFrame) -> DataFrame:
    """(user, keys): the number of live keys of each user."""
    return values.groupBy("user").agg(F.count("*").alias("keys"))


def value_sizes(values: DataFrame) -> DataFrame:
    return values.select("key", F.length("value").cast("long").alias("size"))


def split_chunks(values: DataFrame, size: int = CHUNK) -> DataFrame:
    """(key, offset, length, chunk): fixed chunks of each value, the last one as short as it comes."""
    rows = values.select("key", "value", F.explode(F.expr(f"sequence(0L, greatest(length(value) - 1, 0) div {size})")).alias("n"))
    rows = rows.select("key", (F.col("n") * size).alias("offset"), F.expr(f"substring(value, cast(n * {size} + 1 as int), {size})").alias("chunk"))
    return rows.select("key", "offset", F.length("chunk").cast("long").alias("length"), "chunk").filter("length > 0")


def read_ranges(values: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, rejects) of asks (key, offset, len): the bytes of each range; ranges past the end are rejected."""
    rows = asks.join(values.select("key", "value"), "key", "left")
    good = F.coalesce((F.col("offset") >= 0) & (F.col("offset") + F.col("len") <= F.length("value")), F.lit(False))
    return rows.filter(good).select("key", "offset", "len", F.expr("substring(value, cast(offset + 1 as int), cast(len as int))").alias("data")), rows.filter(~good).select("key", "offset", "len")


def patch_cells(values: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): values (key, value, seq) after patches (key, seq, offset, data) that follow the last set, as
    (key, slot, item); of overlapping patches the last wins. Patches beyond the value or of no key are rejected."""
    rows = patches.join(values.select("key", F.col("seq").alias("set_seq"), F.length("value").alias("size")), "key", "left")
    fits = F.coalesce((F.col("offset") >= 0) & (F.col("offset") + F.length("data") <= F.col("size")), F.lit(False))
    writes = values.select("key", "seq", F.lit(0).cast("long").alias("offset"), F.col("value").alias("data")).unionByName(
        rows.filter(fits & (F.col("seq") > F.col("set_seq"))).select("key", "seq", F.col("offset").cast("long").alias("offset"), "data"))
    cells = writes.filter(F.length("data") > 0).select("key", "seq", "offset", "data", F.explode(F.expr("sequence(0, length(data) - 1)")).alias("i"))
    cells = cells.select("key", (F.col("offset") + F.col("i")).alias("slot"), "seq", F.expr("substring(data, i + 1, 1)").alias("item"))
    return cells.groupBy("key", "slot").agg(F.max_by("item", "seq").alias("item")), rows.filter(~fits).select("key", "seq", "offset", "data")


def assemble(cells: DataFrame) -> DataFrame:
    """(key, value) of text cells: one value of fixed size per key."""
    return cells.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "item"))), lambda x: x["item"]), "").alias("value"))


def live_appends(ops: DataFrame) -> DataFrame:
    """(key, seq, value): appends after the key's last clear."""
    cleared = ops.filter("op = 'clear'").groupBy("key").agg(F.max("seq").alias("_c"))
    return ops.filter("op = 'append'").join(cleared, "key", "left").filter("_c is null or seq > _c").select("key", "seq", "value")


def first_appended(appends: DataFrame, n: int) -> DataFrame:
    """(key, value): the first n appended values joined in order."""
    first = number_rows(appends, ["key"], ["seq"], "_n").filter(F.col("_n") < n)
    return first.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))


def dirty_ranges(flags: DataFrame) -> DataFrame:
    """(key, offset, length): flagged slots (key, slot) as maximal ranges."""
    return islands(flags, ["key"])


def push_partial(remote: DataFrame, local: DataFrame, dirty: DataFrame) -> DataFrame:
    """Remote cells (key, slot, item) after the dirty slots (key, slot) of the local ones replaced theirs."""
    pushed = local.join(dirty.select("key", "slot"), ["key", "slot"], "left_semi").withColumnRenamed("item", "_new")
    return remote.join(pushed, ["key", "slot"], "full").select("key", "slot", F.coalesce("_new", "item").alias("item"))


def push_masked(remote: DataFrame, local: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): remote cells with those of local where the mask (key, slot, on) is set. Keys whose mask has
    another size than their value are rejected and stay as they are."""
    sizes = local.groupBy("key").agg(F.count("*").alias("n")).join(mask.groupBy("key").agg(F.count("*").alias("m")), "key", "left")
    bad = sizes.filter("m is null or n <> m").select("key")
    on = mask.filter("on").join(bad, "key", "left_anti")
    return push_partial(remote, local, on), bad


def plan_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, action) by versions (key, version, dirty) and (key, version): push where the local copy is dirty, refresh
    where the remote one is newer or there is no local one, else keep."""
    rows = local.join(remote.withColumnRenamed("version", "theirs"), "key", "full")
    action = F.when(F.coalesce("dirty", F.lit(False)), "push").when(F.col("version").isNull() | (F.col("theirs") > F.col("version")), "refresh").otherwise("keep")
    return rows.select("key", action.alias("action"))


def counters(ops: DataFrame) -> DataFrame:
    """(key, total) of incr, decr, incrby and decrby (amount `num`); a key that was only read is 0."""
    signed = F.when(F.col("op") == "incr", 1).when(F.col("op") == "decr", -1).when(F.col("op") == "incrby", F.col("num")).when(F.col("op") == "decrby", -F.col("num")).otherwise(0)
    return ops.groupBy("key").agg(F.coalesce(F.sum(signed.cast("long")), F.lit(0)).alias("total"))


def set_members(ops: DataFrame) -> DataFrame:
    """(key, member) after adds and removes (op add or remove)."""
    last = ops.filter(F.col("op").isin("add", "remove")).groupBy("key", "member").agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op = 'add'").select("key", "member")


def set_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count("*").alias("size"))


def set_difference(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, member): members of key a that are not in key b, for pairs (a, b)."""
    left = pairs.join(members.withColumnRenamed("key", "a"), "a")
    return left.join(members.withColumnRenamed("key", "b"), ["b", "member"], "left_anti").select("a", "b", "member")


def set_intersection(members: DataFrame, pairs: DataFrame) -> DataFrame:
    left = pairs.join(members.withColumnRenamed("key", "a"), "a")
    return left.join(members.withColumnRenamed("key", "b"), ["b", "member"], "left_semi").select("a", "b", "member")


def random_member(members: DataFrame, seed: int = 0) -> DataFrame:
    """(key, member): a member by least seeded hash, so that reruns agree."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"), F.col("member").cast("string")))
    return members.groupBy("key").agg(F.min_by("member", F.struct(drawn, "member")).alias("member"))


def list_items(ops: DataFrame) -> DataFrame:
    """(key, position, value) of pushes to either end (op lpush or rpush), positions from 0."""
    at = F.when(F.col("op") == "lpush", -F.col("seq")).otherwise(F.col("seq"))
    side = F.when(F.col("op") == "lpush", 0).otherwise(1)
    rows = ops.filter(F.col("op").isin("lpush", "rpush")).select("key", at.alias("_at"), side.alias("_side"), "value")
    return number_rows(rows, ["key"], ["_side", "_at"], "position").select("key", "position", "value")


def list_lengths(items: DataFrame) -> DataFrame:
    """(key, length) of the lists (key, position, value)."""
    return items.groupBy("key").agg(F.count("*").alias("length"))


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first n items of each list."""
    return items.filter(F.col("position") < n)


def replay_queues(ops: DataFrame) -> DataFrame:
    """(queue, seq, item_seq): which enqueued item each dequeue gets, item_seq null on an empty queue.

    The n-th dequeue that finds something gets the n-th item. One pass over ranges of each queue's log numbers items and
    such dequeues (`transformers.Balance` says what a range does to the queue before it); numbers are then joined."""
    steps = ops.select("queue", "seq", F.when(F.col("op") == "enqueue", 1).otherwise(-1).alias("d"))

    def emit(key: tuple, start: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held, came, gone = start
        for seq, step in rows:
            if step > 0:
                yield key[0], seq, "in", came
                held, came = held + 1, came + 1
            elif held:
                yield key[0], seq, "out", gone
                held, gone = held - 1, gone + 1
            else:
                yield key[0], seq, "none", None

    kinds = [ops.schema[c].dataType.simpleString() for c in ("queue", "seq")]
    numbered = scan_ranges(steps, ["queue"], ["seq"], lambda rows: Balance(r[1] for r in rows), emit, (0, 0, 0), f"queue {kinds[0]}, seq {kinds[1]}, kind string, n long")
    numbered = cut(numbered)
    items = numbered.filter("kind = 'in'").select(F.col("queue").alias("_q"), F.col("n").alias("_n"), F.col("seq").alias("item_seq"))
    asks = numbered.filter("kind <> 'in'")
    return asks.join(items, F.col("queue").eqNullSafe(F.col("_q")) & (F.col("n") == F.col("_n")), "left").select("queue", "seq", "item_seq")


def live_values(ops: DataFrame, now) -> DataFrame:
    """(key, value, ttl_s) at `now`: the last set (seq, ts, value, ttl_s), with the lifetime of the last set or expire
    after it; keys whose time is over are gone, ttl_s is null without a lifetime."""
    sets = ops.filter("op = 'set'").groupBy("key").agg(F.max(F.struct("seq", "value")).alias("s"))
    last = ops.filter(F.col("op").isin("set", "expire")).groupBy("key").agg(F.max(F.struct("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "ttl_s")).alias("e"))
    rows = sets.join(last, "key")
    left = (F.col("e.ts") + F.col("e.ttl_s") * 1_000_000 - F.unix_micros(F.lit(now).cast("timestamp"))) / 1_000_000
    return rows.withColumn("ttl_s", F.floor(left)).filter("ttl_s is null or ttl_s > 0").select("key", "s.value", "ttl_s")


def fold_key(rows: Iterator[tuple], value: str | None = None, ends: float | None = None) -> Iterator[tuple[tuple, bool, str | None, float | None]]:
    """(row, done, value, ends) after each row (seq, at, op, arg, ttl, offset, ...) of one key in order.

    setnx sets an absent or expired key; delifeq deletes if the value is arg; set and del always act. chunk writes arg
    at an offset of a value that is long enough; expire gives a value a new lifetime. append and clear act on the
    key's list, which no other operation touches."""
    for row in rows:
        _, at, op, arg, ttl, offset = row[:6]
        if ends is not None and at is not None and at >= ends:
            value = ends = None
        done = True
        if op == "set" or (op == "setnx" and value is None):
            value, ends = arg, at + ttl if lasting(ttl) else None
        elif op == "del" or (op == "delifeq" and value is not None and value == arg):
            done = value is not None
            value = ends = None
        elif op == "chunk" and value is not None and (new := patched(value, offset, arg)) is not None:
            value = new
        elif op == "expire" and value is not None and lasting(ttl):
            ends = at + ttl
        else:
            done = op in ("append", "clear")
        yield row, done, value, ends


def conditional_writes(ops: DataFrame) -> DataFrame:
    """(key, seq, done, value, appended) after each operation (seq, at, op, arg, ttl in seconds, offset): whether it took
    effect, the key's value and the length of its list, appends since the last clear.

    Each operation depends on the one before. A key's log is cut into ranges, each of which becomes a function of the
    state before it (`transformers.KeyLog`); a key's functions are applied in a row, and the ranges run with the states
    that these give. So a key with most of the rows is spread over tasks, whatever its operations are. An operation other
    than those of fold_key does nothing; a null key is a key."""
    rows = ops.select("key", "seq", "at", "op", "arg", "ttl", "offset")

    def emit(key: tuple, start: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        (value, ends), n = start[0] or (None, None), start[1]
        for row, done, value, _ in fold_key(group, value, ends):
            n = n + 1 if row[2] == "append" else 0 if row[2] == "clear" else n
            yield key[0], row[0], done, value, n

    kind = ops.schema["key"].dataType.simpleString()
    return scan_ranges(rows, ["key"], ["seq"], lambda group: KeyLog(r[1:6] for r in group), emit, (None, 0), f"key {kind}, seq long, done boolean, value string, appended long")


def publish_results(ops: DataFrame, result_ttl_s: int, status_ttl_s: int) -> tuple[DataFrame, DataFrame]:
    """(list rows, status): results (key, seq, ts, value) appended to the key's list, and its last value, each with
    the time at which it ends."""
    ends = lambda s: (F.col("ts") + F.make_interval(secs=F.lit(s))).alias("expires")
    status = ops.groupBy("key").agg(F.max(F.struct("seq", "ts", "value")).alias("x")).select("key", "x.value", F.col("x.ts").alias("ts"))
    return ops.select("key", "seq", "value", ends(result_ttl_s)), status.select("key", "value", ends(status_ttl_s))
