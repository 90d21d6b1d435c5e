"""Stateful streaming jobs over the logic of the batch operators.

Each job takes a streaming DataFrame and gives one; once its stream is drained, it has given what the batch form
gives on the whole input. Custom state is keyed, so it spreads over the shuffle partitions.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.diffmerge import fold_by_op
from ..operators.results import FROZEN, MIGRATED
from ..operators.state import fold_key
from ..operators.versions import VersionedTable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reorder(StatefulProcessor):
    """Per channel: the number expected next, and the messages that came before their turn, in blocks of BLOCK numbers that
    are read and written as one. A batch meets each block once, however many of its messages are there."""

    BLOCK = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "seq long")
        self.held = handle.getMapState("held", "block long", "seqs array<bigint>, arrivals array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, came = (self.expected.get() or (0,))[0], {}
        for pdf in rows:
            for seq, arrival in zip(pdf["seq"].tolist(), pdf["arrival"].tolist()):
                if seq >= expected:
                    came.setdefault(seq // self.BLOCK, {})[seq] = arrival
        start, at = expected, expected // self.BLOCK
        while True:
            block = {**self._block(at), **came.pop(at, {})}
            out, first = [], expected
            while expected in block:
                out.append((*key, expected, block.pop(expected)))
                expected += 1
            self._keep(at, block)
            if out:
                yield pd.DataFrame(out, columns=["group", "src", "dst", "seq", "arrival"])
            if expected == first or expected // self.BLOCK == at:
                break
            at += 1
        for k, fresh in came.items():
            self._keep(k, {**self._block(k), **fresh})
        if expected != start:
            self.expected.update((expected,))

    def _block(self, k: int) -> dict[int, int]:
        found = self.held.getValue((k,)) if self.held.containsKey((k,)) else None
        return dict(zip(*found)) if found else {}

    def _keep(self, k: int, block: dict[int, int]) -> None:
        if block:
            self.held.updateValue((k,), (list(block), list(block.values())))
        elif self.held.containsKey((k,)):
            self.held.removeKey((k,))

    def close(self) -> None:
        pass


def reorder(messages: DataFrame) -> DataFrame:
    """Delivers messages (group, src, dst, seq, arrival) in the order of their channel, without gaps."""
    return messages.groupBy("group", "src", "dst").transformWithStateInPandas(
        Reorder(), outputStructType="group long, src long, dst long, seq long, arrival long", outputMode="Append", timeMode="None")


class LiveState(StatefulProcessor):
    """Per key: its value with the time at which that ends, and its list of appended values. With event time, a value that
    has an end has a timer there, which takes it out of the state once the watermark has passed."""

    def __init__(self, timed: bool = False) -> None:
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string, ends double")
        self.appended = handle.getListState("appended", "value string")
        self.length = handle.getValueState("length", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        value, ends = self.state.get() or (None, None)
        before, n = ends, (self.length.get() or (0,))[0]
        out, waiting = [], []
        steps = zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("seq", "at", "op", "arg", "ttl", "offset")])
        for row, done, value, ends in fold_key(steps, value, ends):
            if row[2] == "append":
                waiting.append((row[3],))
                n += 1
            elif row[2] == "clear":
                self.appended.clear()
                waiting, n = [], 0
            out.append((key[0], int(row[0]), done, value, n))
        if waiting:
            self.appended.appendList(waiting)
        if n:
            self.length.update((n,))
        else:
            self.length.clear()
        if value is None:
            self.state.clear()
        else:
            self.state.update((value, ends))
        if self.timed and ends != before:
            self._retime(before, ends if value is not None else None)
        yield pd.DataFrame(out, columns=["key", "seq", "done", "value", "appended"])

    def _retime(self, before: float | None, ends: float | None) -> None:
        if before is not None:
            self.handle.deleteTimer(_millis(before))
        if ends is not None:
            self.handle.registerTimer(_millis(ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing is said: the next operation finds the key absent, as it would by the clock."""
        if self.state.exists():
            ends = self.state.get()[1]
            if ends is not None and _millis(ends) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
        yield pd.DataFrame({"key": [], "seq": [], "done": [], "value": [], "appended": []}).astype({"key": "int64", "seq": "int64", "done": "bool", "value": "object", "appended": "int64"})

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    """The first whole millisecond from which the time is over."""
    return math.ceil(seconds * 1000)


def live_state(ops: DataFrame, late: str | None = None) -> DataFrame:
    """(key, seq, done, value, appended) after each operation (key, seq, at, op, arg, ttl, offset), as from
    conditional_writes; operations of a key must come in order of their batches.

    Without `late`, a value whose time is over stays in the state until the key's next operation. With it, operations
    (whose `at` is in seconds) may be that much behind the newest one, later ones are dropped, and a value leaves the
    state once its time is that far back, so that keys which are not used again take no room."""
    timed = late is not None
    rows = ops.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", late) if timed else ops
    return rows.groupBy("key").transformWithStateInPandas(
        LiveState(timed), outputStructType="key long, seq long, done boolean, value string, appended long", outputMode="Append", timeMode="EventTime" if timed else "None")


class Registry(StatefulProcessor):
    """Per host: its record and the time of its last accepted register. A timer takes the host out when it has been silent
    for longer than the time-out; a host that registers after that is new, as by the rules it is."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "slots long, used long, ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.record.get()
        before, last = held, None
        pdf = pd.concat(list(rows)).sort_values("seq")
        for seq, op, ts, slots, used, overwrite in zip(*[pdf[c].tolist() for c in ("seq", "op", "ms", "slots", "used", "overwrite")]):
            if op == "remove":
                held, last = None, (seq, None)
            elif slots >= 0:
                fresh = held is None or overwrite or ts - held[2] > self.timeout
                held = (slots, used, ts) if fresh else (held[0], held[1], ts)
                last = (seq, held)
        if before is not None and (held is None or held[2] != before[2]):
            self.handle.deleteTimer(before[2] + self.timeout + 1)
        if held is None:
            self.record.clear()
        else:
            self.record.update(tuple(int(x) for x in held))
            self.handle.registerTimer(int(held[2]) + self.timeout + 1)
        kinds = {"host": "int64", "seq": "int64", "event": "object", "slots": "Int64", "used": "Int64", "register_ts": "Int64"}
        out = [] if last is None else [(key[0], last[0], "gone" if last[1] is None else "live", *(last[1] or (None, None, None)))]
        yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.record.exists():
            slots, used, ts = self.record.get()
            if ts + self.timeout + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.record.clear()
                out = [(key[0], None, "silent", slots, used, ts)]
        kinds = {"host": "int64", "seq": "Int64", "event": "object", "slots": "Int64", "used": "Int64", "register_ts": "Int64"}
        yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    def close(self) -> None:
        pass


def live_registry(log: DataFrame, timeout_s: int, late: str = "1 hour") -> DataFrame:
    """Changes (host, seq, event, slots, used, register_ts) of a host registry over a log (seq, host, op, ts, slots, used,
    overwrite) whose rows of a host come in order of their batches: after each batch the record of each host that it
    touched (live) or that it was removed (gone), and once the watermark is past a live host's time-out, that it is
    silent, from when on it takes no state. The last live or gone row of each host is what host_registry gives for the
    log so far; rows that are more than `late` behind the newest one are dropped."""
    rows = log.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("host").transformWithStateInPandas(
        Registry(timeout_s * 1000), outputStructType="host long, seq long, event string, slots long, used long, register_ts long", outputMode="Append", timeMode="EventTime")


class BatchProgress(StatefulProcessor):
    """Per app: the latest result of each task that has one. Says so once when the last task has come."""

    BLOCK = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Tasks by blocks of BLOCK ids, read and written as one: for a task its result's code, or null, and whether it was frozen.
        self.seen = handle.getMapState("seen", "block long", "ids array<bigint>, codes array<int>, frozen array<boolean>")
        self.count = handle.getValueState("count", "n long, failed long, frozen long, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, failed, frozen, over = self.count.get() or (0, 0, 0, False)
        blocks: dict[int, dict] = {}
        out, came = [], sorted((row for pdf in rows for row in zip(*[pdf[c].tolist() for c in ("seq", "id", "return_value", "expected")])), key=lambda row: row[0])
        for _, task, value, expected in came:
            if value == MIGRATED:
                continue
            at = task // self.BLOCK
            if at not in blocks:
                blocks[at] = self._block(at)
            before, was = blocks[at].get(task, (None, False))
            if value == FROZEN:
                frozen += not was
                blocks[at][task] = (before, True)
                continue
            blocks[at][task] = (value, was)
            n, failed = n + (before is None), failed + (value != 0) - (before is not None and before != 0)
            if n == expected and not over:
                over = True
                out.append((key[0], n, failed, frozen))
        for at, block in blocks.items():
            self.seen.updateValue((at,), (list(block), [code for code, _ in block.values()], [was for _, was in block.values()]))
        self.count.update((n, failed, frozen, over))
        if out:
            yield pd.DataFrame(out, columns=["app", "done", "failed", "frozen"])

    def _block(self, k: int) -> dict[int, tuple]:
        found = self.seen.getValue((k,)) if self.seen.containsKey((k,)) else None
        return {task: (code, was) for task, code, was in zip(*found)} if found else {}

    def close(self) -> None:
        pass


def batch_progress(results: DataFrame) -> DataFrame:
    """(app, done, failed, frozen) of each app when the last of its `expected` tasks reports. results: (app, id, seq,
    return_value, expected). As in result_table, of repeated results the latest counts, migrated ones are ignored, and
    frozen ones are kept apart: `frozen` tasks have reported so until then."""
    return results.groupBy("app").transformWithStateInPandas(
        BatchProgress(), outputStructType="app long, done long, failed long, frozen long", outputMode="Append", timeMode="None")


def wait_for_results(requests: DataFrame, results: DataFrame, timeout: str, late: str = "1 hour") -> DataFrame:
    """Requests (app, id, asked) joined to results (app, id, ts, return_value) that come within the time-out; after
    it, a request without one gets a null result. Rows that are more than `late` behind the newest row of their stream
    are dropped."""
    # A request looks in the time slice of its own, as long as the time-out; a result stands in each slice from which it can
    # be asked for, which are two, and once more where days of the calendar (or months) are longer than at the epoch.
    slack = "4 days" if re.search("month|year", timeout, re.IGNORECASE) else "1 hour"
    slice_of = lambda at: f"unix_micros({at}) div greatest(unix_micros(timestamp_seconds(0) + interval {timeout}) - unix_micros(timestamp_seconds(0)), 1000000L)"
    q = requests.withWatermark("asked", late).withColumn("_slice", F.expr(slice_of("asked"))).alias("q")
    r = results.withWatermark("ts", late).withColumn("_slice", F.explode(F.expr(f"sequence({slice_of(f'(ts - interval {timeout} - interval {slack})')}, {slice_of('ts')})"))).alias("r")
    on = F.expr(f"q.app = r.app and q.id = r.id and q._slice = r._slice and r.ts >= q.asked and r.ts <= q.asked + interval {timeout}")
    return q.join(r, on, "left").select("q.app", "q.id", "q.asked", "r.ts", "r.return_value")


def host_sessions(beats: DataFrame, timeout: str, late: str = "1 hour") -> DataFrame:
    """(host, start, end, beats): spans in which a host (host, ts) was never silent for `timeout`; it drops out at
    the end of one. Beats that are more than `late` behind the newest one are dropped."""
    s = beats.withWatermark("ts", late).groupBy("host", F.session_window("ts", timeout).alias("w")).agg(F.count("*").alias("beats"))
    return s.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def merge_diffs(diffs: DataFrame) -> DataFrame:
    """Running folds (dataset, slot, op, delta, n_diffs) of diffs (dataset, slot, op, delta, worker, seq) of all
    operations, for an update or complete sink: the aggregation of fold_by_op."""
    return fold_by_op(diffs)


def upsert_into(path: str, keys: list[str], buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch's rows replace those of their keys in a versioned table that is dealt into buckets
    by key. A batch rewrites only the buckets that it touches and is seen once its manifest is there; a batch that comes
    again after that is known by its number. Files that the last `keep` manifests do not name are deleted."""

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, keys, buckets)
        if table.manifest().note.get("batch", -1) < number:
            table.upsert(batch, {"batch": number})
            table.clean(keep)

    return write


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_into keeps."""
    return VersionedTable(spark, path, []).read()


def stream_of(df: DataFrame, folder: str, order: str, steps: int = 3, files: int | None = None) -> DataFrame:
    """df as a stream: written as `steps` ranges of `order`, one read a batch. A range is written by `files` tasks, of
    which each has rows if the range has as many, by default one a core; ranges are added one after the other, since the
    source reads files by age."""
    spark = df.sparkSession
    files = files or max(4, spark.sparkContext.defaultParallelism)
    dealt = df.repartitionByRange(steps * files, order).withColumn("_part", F.expr(f"spark_partition_id() div {files}").cast("int"))
    dealt.write.partitionBy("_part").parquet(f"{folder}-parts")
    parts = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _part int").parquet(f"{folder}-parts")
    for part in range(steps):
        parts.filter(F.col("_part") == part).drop("_part").repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an append job over all there is and returns what it has given."""
    spark, out = stream.sparkSession, f"{folder}/out-{uuid.uuid4().hex}"
    with rocksdb(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/progress-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class rocksdb:
    """Within it, new streaming queries keep their state in RocksDB, which custom state needs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *error) -> None:
        self.spark.conf.set(self.KEY, self.before)
