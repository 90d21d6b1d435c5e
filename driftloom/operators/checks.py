"""Validation, stamping and filtering of tasks, batches and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running


def batch_validity(batches: DataFrame, tasks: DataFrame) -> DataFrame:
    """(app, valid) of batches (app, user, function) with tasks (app, id, user, function, task_app): user and function
    are set, every task has the batch's user and app and a function of its own; a batch without tasks is refused
    only if its app is 0."""
    good = (F.col("t_user") == F.col("user")) & (F.col("task_app") == F.col("app")) & (F.coalesce("t_function", F.lit("")) != "")
    rows = batches.join(tasks.select("app", "task_app", F.col("user").alias("t_user"), F.col("function").alias("t_function")), "app", "left")
    seen = F.col("task_app").isNotNull() | F.col("t_user").isNotNull() | F.col("t_function").isNotNull()
    per = rows.groupBy("app", "user", "function").agg(F.count_if(seen).alias("n"), F.bool_and(F.when(seen, F.coalesce(good, F.lit(False)))).alias("ok"))
    set_ = (F.coalesce("user", F.lit("")) != "") & (F.coalesce("function", F.lit("")) != "")
    return per.select("app", (set_ & F.when(F.col("n") == 0, F.col("app") != 0).otherwise(F.col("ok"))).alias("valid"))


def stamp(tasks: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """tasks with `column` (app or group) replaced by mapping (column, new) where it has an entry."""
    return tasks.join(mapping.withColumnRenamed("new", "_new"), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(tasks.columns)


def fill_fields(tasks: DataFrame, now_ms: int, natural_key: list[str]) -> DataFrame:
    """Fills missing id and app (null or 0), start_ts, result_key and status_key; values that are there stay. New
    ids come from a hash of the natural key, so reruns agree."""
    text = lambda salt: F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in natural_key])
    positive = lambda salt: (F.conv(F.substring(F.md5(text(salt)), 1, 8), 16, 10).cast("long") % ((1 << 31) - 1) + 1).cast("long")
    out = tasks.withColumns({
        "id": F.when(F.col("id") > 0, F.col("id")).otherwise(positive("id")), "app": F.coalesce(F.when(F.col("app") != 0, F.col("app")), positive("app")),
        "start_ts": F.when(F.col("start_ts") > 0, F.col("start_ts")).otherwise(F.lit(now_ms)),
    })
    return out.withColumns({"result_key": F.concat(F.lit("result_"), "id"), "status_key": F.concat(F.lit("status_"), "id")})


def live_hosts(register_log: DataFrame, now_ms: int, timeout_s: int) -> DataFrame:
    """The latest row (host, slots, used, register_ts) of each host that is not silent for more than the time-out."""
    last = register_log.groupBy("host").agg(F.max(F.struct("register_ts", "slots", "used")).alias("x")).select("host", "x.*")
    return last.filter(F.lit(now_ms) - F.col("register_ts") <= timeout_s * 1000)


def host_registry(log: DataFrame, timeout_s: int) -> DataFrame:
    """(host, slots, used, register_ts) after a log (seq, host, op, ts in ms, slots, used, overwrite): negative slots
    are refused, a new or expired host takes the new record, a live one only with overwrite; every accepted
    register refreshes the time; remove deletes.

    What came before a host's last remove is gone. After it a record is taken where the host is new, where overwrite is
    set, or where the accepted register before is older than the time-out; the last one taken stays, with the time of
    the last register."""
    gone = log.filter("op = 'remove'").groupBy("host").agg(F.max("seq").alias("_gone")).withColumnRenamed("host", "_h")
    rows = log.filter("op <> 'remove' and slots >= 0").join(gone, F.col("host").eqNullSafe(F.col("_h")), "left").filter("_gone is null or seq > _gone").select("host", "seq", "ts", "slots", "used", "overwrite")
    rows = running(rows, ["host"], ["seq"], {"_last": ("max", F.struct("seq", "ts"))}, inclusive=False)
    taken = F.col("_last").isNull() | F.col("overwrite") | (F.col("ts") - F.col("_last.ts") > timeout_s * 1000)
    out = rows.groupBy("host").agg(F.max(F.when(taken, F.struct("seq", "slots", "used"))).alias("r"), F.max_by("ts", "seq").alias("register_ts"))
    return out.select("host", "r.slots", "r.used", "register_ts")


def exclude_tenants(hosts: DataFrame, placements: DataFrame, tenant) -> DataFrame:
    """Hosts that run no task of another tenant. placements: (host, tenant)."""
    return hosts.join(placements.filter(F.col("tenant") != tenant).select("host"), "host", "left_anti")


def exclude_marked(hosts: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped)."""
    return hosts.join(marked.select("host"), "host", "left_anti"), hosts.join(marked.select("host"), "host", "left_semi").select("host")


def request_types(requests: DataFrame, in_flight: DataFrame) -> DataFrame:
    """(app, kind, type): NEW if the app is unknown, DIST_CHANGE if known and kind is migration, else SCALE_CHANGE."""
    rows = requests.join(in_flight.select("app").distinct().withColumn("_known", F.lit(True)), "app", "left")
    kind = F.when(F.col("_known").isNull(), "NEW").when(F.col("kind") == "migration", "DIST_CHANGE").otherwise("SCALE_CHANGE")
    return rows.select("app", "kind", kind.alias("type"))


def preset_hosts(tasks: DataFrame, presets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, rejects): each task (app, id, group_idx) takes the preset host of its (app, group_idx)."""
    rows = tasks.join(presets.select("app", "group_idx", "host"), ["app", "group_idx"], "left")
    return rows.filter("host is not null").select("app", "id", "group_idx", "host"), rows.filter("host is null").select("app", "id", "group_idx")


def idle_workers(uses: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Workers of (worker, ts, running) last used at least timeout_ms ago with no running task."""
    per = uses.groupBy("worker").agg(F.max("ts").alias("last_ts"), F.sum(F.col("running").cast("int")).alias("n"))
    return per.filter((F.lit(now_ms) - F.col("last_ts") >= timeout_ms) & (F.col("n") == 0)).select("worker", "last_ts")


def exchange_violations(messages: DataFrame) -> DataFrame:
    """Rows of (world, size, src, dst, send_type, recv_type, send_count, recv_count) that break a rule, with it: a rank
    outside of [0, size), or types that differ while the counts agree."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("size"))
    why = F.when(~(inside("src") & inside("dst")), "rank").when((F.col("send_type") != F.col("recv_type")) & (F.col("send_count") == F.col("recv_count")), "type")
    return messages.withColumn("reason", why).filter("reason is not null")
