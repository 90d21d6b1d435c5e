"""Queries of user functions and streaming jobs, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffmerge as dm
from ..operators import tasks as u
from ..operators.results import FROZEN, MIGRATED
from ..streaming import jobs as j
from .allocation_queries import ARRIVED, _arrived
from .diff_queries import BASE, _regions, base
from .registry import read, register, scratch
from .state_queries import LOG, logged

# -- user functions: documents as tasks ----------------------------------------------------------------------------


def _tasks(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("length"), F.lit("fail"), F.lit("words"), F.lit("nobody")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(s, d, "documents").select(F.lit(1).cast("long").alias("app"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), name.alias("function"))


def length(task: dict) -> tuple[int, str]:
    return len(task["text"]) % 3, f"length {len(task['text'])}"


def fail(task: dict) -> int:
    raise ValueError(f"task {task['id']} fails")


def words(task: dict) -> tuple[int, str]:
    return 0, str(task["text"].count(" "))


register("u01_run_tasks", lambda s, d: u.run_tasks(_tasks(s, d), length), "SELECT 1::BIGINT AS app, doc_id AS id, (length(coalesce(text, '')) % 3)::INT AS return_value, 'length ' || length(coalesce(text, '')) AS output FROM documents")


def _double_odd(task: dict, slots, values):
    """Worker k adds k + 1 to every slot that k + 2 divides."""
    return values + (slots % (task["worker"] + 2) == 0) * (task["worker"] + 1)


def u02_fork_join_tasks(s: SparkSession, d: str) -> DataFrame:
    b = base(s, d)
    # Each worker has a task for every thousand slots.
    ranges = b.groupBy("dataset").agg(F.max("slot").alias("last")).select("dataset", F.explode(F.expr("sequence(0L, last div 1000)")).alias("k"))
    work = ranges.select("dataset", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("worker"), (F.col("k") * 1000).alias("lo"), (F.col("k") * 1000 + 1000).alias("hi"))
    return u.fork_join_tasks(work, b, _regions(s, d).withColumn("op", F.when(F.col("op") == "max", "sum").otherwise(F.col("op"))), _double_odd)[0]


register("u02_fork_join_tasks", u02_fork_join_tasks, f"""
WITH {BASE}, x AS (SELECT dataset, slot, value, CASE WHEN slot % 2 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN slot % 3 = 0 THEN 2 ELSE 0 END AS b, CASE WHEN slot % 4 = 0 THEN 3 ELSE 0 END AS c FROM b)
SELECT dataset, slot, value + CASE WHEN slot < 50 OR (slot >= 300 AND slot < 400) THEN a + b + c WHEN slot >= 100 AND slot < 200 THEN 0 WHEN c > 0 THEN c WHEN b > 0 THEN b ELSE a END AS value FROM x""")
register("u03_dispatch", lambda s, d: u.dispatch(_tasks(s, d), {"length": length, "fail": fail, "words": words}), """
WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)
SELECT 1::BIGINT AS app, id, (CASE id % 4 WHEN 0 THEN length(t) % 3 WHEN 2 THEN 0 ELSE 1 END)::INT AS return_value,
       CASE id % 4 WHEN 0 THEN 'length ' || length(t) WHEN 1 THEN 'task ' || id || ' fails' WHEN 2 THEN (length(t) - length(replace(t, ' ', '')))::VARCHAR ELSE 'unknown function nobody' END AS output FROM t""")


def _halves(task: dict) -> tuple[int, str, list[int]]:
    """A task calls the two halves of its number, down to 16."""
    n = task["id"]
    return 0, "", [n // 2, n // 2 + 1] if n >= 16 else []


def _chained(s: SparkSession, d: str) -> DataFrame:
    return u.run_chained(read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("app"), F.col("s_suppkey").alias("id")), _halves)[1]


register("u04_chained_tasks", _chained, """
WITH RECURSIVE t AS (SELECT s_nationkey::BIGINT AS app, s_suppkey AS id FROM supplier UNION ALL SELECT app, unnest([id // 2, id // 2 + 1]) FROM t WHERE id >= 16)
SELECT app, id AS parent_id, unnest([id // 2, id // 2 + 1]) AS child_id FROM t WHERE id >= 16""")

# -- streams: events in small files ----------------------------------------------------------------------------------


def t01_reorder(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "stream")
    return j.drain(j.reorder(j.stream_of(_arrived(s, d), f"{at}/in", "arrival")), at)


register("t01_reorder", t01_reorder, f'WITH {ARRIVED} SELECT grp AS "group", src, dst, seq, arrival FROM v WHERE seq = n')


def t02_live_state(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "stream")
    return j.drain(j.live_state(j.stream_of(logged(s, d), f"{at}/in", "seq")), at)


register("t02_live_state", t02_live_state, f"WITH {LOG} SELECT key, seq, done, value, appended FROM x WHERE n > 0")


def t03_batch_progress(s: SparkSession, d: str) -> DataFrame:
    """Apps of 100 events on 25 tasks; some say migrated or frozen, some tasks report again, some never."""
    at = scratch(s, "stream")
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", MIGRATED).when(F.col("event_type") == "purchase", FROZEN).otherwise(0)
    rows = read(s, d, "events").select(F.col("event_id").alias("seq"), F.expr("event_id div 100").alias("app"), (F.col("event_id") * 7 % 25).alias("id"), code.cast("int").alias("return_value"), F.lit(25).alias("expected"))
    return j.drain(j.batch_progress(j.stream_of(rows, f"{at}/in", "seq")), at)


register("t03_batch_progress", t03_batch_progress, """
WITH e AS (SELECT event_id AS seq, event_id // 100 AS app, event_id * 7 % 25 AS id, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -99 WHEN 'purchase' THEN -98 ELSE 0 END AS r FROM events),
f AS (SELECT app, id, min(seq) AS first FROM e WHERE r NOT IN (-99, -98) GROUP BY ALL), d AS (SELECT app, max(first) AS last FROM f GROUP BY app HAVING count(*) = 25),
l AS (SELECT app, id, arg_max(r, seq) AS r FROM e JOIN d USING (app) WHERE r NOT IN (-99, -98) AND seq <= last GROUP BY ALL), z AS (SELECT app, count(DISTINCT id) AS frozen FROM e JOIN d USING (app) WHERE r = -98 AND seq <= last GROUP BY app)
SELECT app, count(*) AS done, count(*) FILTER (WHERE r <> 0) AS failed, coalesce(any_value(frozen), 0) AS frozen FROM l LEFT JOIN z USING (app) GROUP BY app""")


def t04_wait_for_results(s: SparkSession, d: str) -> DataFrame:
    """Views wait for the next errors of their user's group; rows far in the future on both sides end the waiting of
    all others."""
    at = scratch(s, "stream")
    e = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = s.range(1).select(F.lit(-1).cast("long").alias("app"), F.lit(0).cast("long").alias("id"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("ts"))
    asked = e.filter("event_type = 'view'").select((F.col("user_id") % 20).alias("app"), (F.col("event_id") % 10).alias("id"), "ts").unionByName(end).withColumnRenamed("ts", "asked")
    found = e.filter("event_type = 'error'").select((F.col("user_id") % 20).alias("app"), (F.col("event_id") % 10).alias("id"), "ts").unionByName(end).withColumn("return_value", F.lit(1))
    out = j.drain(j.wait_for_results(j.stream_of(asked, f"{at}/asked", "asked"), j.stream_of(found, f"{at}/found", "ts"), "12 hours"), at)
    return out.filter("app >= 0").select("app", "id", F.unix_micros("asked").alias("asked"), F.unix_micros("ts").alias("ts"), "return_value")


register("t04_wait_for_results", t04_wait_for_results, """
WITH q AS (SELECT user_id % 20 AS app, event_id % 10 AS id, ts AS asked FROM events WHERE event_type = 'view'),
r AS (SELECT user_id % 20 AS app, event_id % 10 AS id, ts FROM events WHERE event_type = 'error')
SELECT q.app, q.id, epoch_us(asked) AS asked, epoch_us(r.ts) AS ts, CASE WHEN r.ts IS NOT NULL THEN 1 END::INT AS return_value FROM q LEFT JOIN r ON q.app = r.app AND q.id = r.id AND r.ts >= asked AND r.ts <= asked + INTERVAL 12 HOUR""")


def t05_host_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that are over when the stream ends: a last beat far in the future closes the others."""
    at = scratch(s, "stream")
    e = read(s, d, "events").select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"))
    end = s.range(1).select(F.lit(-1).cast("long").alias("host"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("ts"))
    out = j.drain(j.host_sessions(j.stream_of(e.unionByName(end), f"{at}/in", "ts"), "6 hours"), at)
    return out.filter("host >= 0").select("host", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "beats")


register("t05_host_sessions", t05_host_sessions, """
WITH e AS (SELECT user_id AS host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY ts) AS g FROM e)
SELECT host, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 21600000000 AS "end", count(*) AS beats FROM g GROUP BY host, g""")


def t06_merge_diffs(s: SparkSession, d: str) -> DataFrame:
    """Line items as diffs of all operations, the operation by the part."""
    at = scratch(s, "stream")
    op = F.element_at(F.array(*[F.lit(x) for x in ("sum", "product", "max", "min", "xor", "overwrite")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = read(s, d, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_partkey").alias("slot"), op.alias("op"), F.when(op == "product", F.col("l_quantity") % 4 - 1).otherwise(F.col("l_quantity")).cast("long").alias("delta"),
        F.col("l_linenumber").alias("worker"), F.struct("l_orderkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_shipdate").alias("seq"), "l_orderkey")
    stream = j.merge_diffs(j.stream_of(rows, f"{at}/in", "l_orderkey"))
    done = stream.writeStream.outputMode("update").foreachBatch(j.upsert_into(f"{at}/table", [*dm.CELL, "op"], buckets=8)).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    done.awaitTermination()
    return j.read_upserts(s, f"{at}/table")


register("t06_merge_diffs", t06_merge_diffs, """
WITH q AS (SELECT l_returnflag AS dataset, l_partkey AS slot, ['sum', 'product', 'max', 'min', 'xor', 'overwrite'][l_partkey % 6 + 1] AS op, l_quantity::BIGINT AS x, l_linenumber AS worker, (l_orderkey, l_suppkey, l_extendedprice, l_tax, l_discount, l_shipdate) AS seq FROM lineitem)
SELECT dataset, slot, op, CASE op WHEN 'sum' THEN sum(x) WHEN 'product' THEN list_reduce(list((x % 4 - 1)::HUGEINT), lambda a, y: a * y) WHEN 'max' THEN max(x) WHEN 'min' THEN min(x) WHEN 'xor' THEN bit_xor(x) ELSE arg_max(x, (worker, seq)) END::BIGINT AS delta, count(*) AS n_diffs FROM q GROUP BY dataset, slot, op""")


def t05_live_registry(s: SparkSession, d: str) -> DataFrame:
    """The registry of p05 as a stream, over the events in order of time; what it holds when all has come."""
    at = scratch(s, "stream")
    e = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = e.select(
        (F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), F.col("user_id").alias("host"), F.when(F.col("event_type") == "error", "remove").otherwise("register").alias("op"), "ts",
        (F.floor("value") % 8 - 1).alias("slots"), F.lit(0).cast("long").alias("used"), (F.col("event_type") == "purchase").alias("overwrite"))
    out = j.drain(j.live_registry(j.stream_of(log, f"{at}/in", "seq"), 36000), at).filter("event <> 'silent'")
    last = out.groupBy("host").agg(F.max(F.struct("seq", "event", "slots", "used", "register_ts")).alias("x"))
    return last.filter("x.event = 'live'").select("host", "x.slots", "x.used", "x.register_ts")


register("t05_live_registry", t05_live_registry, """
WITH l AS (SELECT epoch_us(ts) * 1000 + event_id % 1000 AS seq, user_id AS host, event_type, epoch_us(ts) // 1000 AS ts, floor(value)::BIGINT % 8 - 1 AS slots FROM events),
k AS (SELECT l.*, lag(l.ts) OVER (PARTITION BY host ORDER BY seq) AS before FROM l LEFT JOIN (SELECT host, max(seq) AS gone FROM l WHERE event_type = 'error' GROUP BY host) USING (host) WHERE event_type <> 'error' AND slots >= 0 AND (gone IS NULL OR seq > gone))
SELECT host, arg_max(slots, seq) FILTER (WHERE before IS NULL OR event_type = 'purchase' OR ts - before > 36000000) AS slots, 0::BIGINT AS used, arg_max(ts, seq) AS register_ts FROM k GROUP BY host""")
