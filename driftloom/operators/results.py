"""Batch results: result tables from result events, batch status, waiters and slot accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import prefix_sums

#: Return values that stand for a migrated and a frozen task.
MIGRATED, FROZEN = -99, -98


def result_table(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, frozen): the latest result of each (app, id) by seq. Migrated results are ignored, frozen ones kept
    apart. `released` is the seq at which the task's slot is given back: that of its first result."""
    rest = events.filter(F.col("return_value") != MIGRATED)
    columns = [c for c in events.columns if c not in ("app", "id")]
    latest = rest.filter(F.col("return_value") != FROZEN).groupBy("app", "id").agg(F.max_by(F.struct(*columns), "seq").alias("x"), F.min("seq").alias("released"))
    frozen = rest.filter(F.col("return_value") == FROZEN).groupBy("app", "id").agg(F.max_by(F.struct(*columns), "seq").alias("x"))
    return latest.select("app", "id", "x.*", "released"), frozen.select("app", "id", "x.*")


def batch_status(asked: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(app, finished, expected, done, results) per asked app, results as (id, return_value) in id order. All but
    the app are null for an app without tasks."""
    rows = tasks.select("app", "id").join(results.select("app", "id", "return_value"), ["app", "id"], "left")
    one = F.when(F.col("return_value").isNotNull(), F.struct("id", "return_value"))
    found = rows.groupBy("app").agg(F.count("*").alias("expected"), F.count("return_value").alias("done"), F.sort_array(F.collect_list(one)).alias("results"))
    return asked.join(found.withColumn("finished", F.col("done") == F.col("expected")), "app", "left").select("app", "finished", "expected", "done", "results")


def finished_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("app").agg(F.count_if(F.col("return_value") != MIGRATED).alias("finished"))


def in_flight(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(app, subtype, size, hosts) of apps with unfinished tasks. tasks: (app, id, subtype, host, world_size, threads);
    size is the world size, else the thread count, else the number of tasks."""
    open_tasks = tasks.join(results.select("app", "id"), ["app", "id"], "left_anti")
    size = F.when(F.max("world_size") > 0, F.max("world_size")).when(F.max("threads") > 0, F.max("threads")).otherwise(F.count("*"))
    return open_tasks.groupBy("app").agg(F.min("subtype").alias("subtype"), size.cast("long").alias("size"), F.sort_array(F.collect_set("host")).alias("hosts"))


def flight_report(tasks: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """(app, state, subtype, size, hosts, migrations): the apps in flight as from in_flight, and those that are frozen
    with their size alone; `migrations` counts the app's results (events) that say migrated so far."""
    moved = events.filter(F.col("return_value") == MIGRATED).groupBy("app").agg(F.count("*").alias("migrations"))
    frozen = frozen_apps(events)
    size = F.when(F.max("world_size") > 0, F.max("world_size"))
    asleep = tasks.join(frozen, "app", "left_semi").groupBy("app").agg(size.cast("long").alias("size"))
    awake = in_flight(tasks.join(frozen, "app", "left_anti"), results).withColumn("state", F.lit("in flight"))
    both = awake.unionByName(asleep.withColumn("state", F.lit("frozen")), allowMissingColumns=True)
    return both.join(moved, "app", "left").select("app", "state", "subtype", "size", "hosts", F.coalesce("migrations", F.lit(0)).alias("migrations"))


def notify_waiters(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(app, id, waiter, return_value): who waits for what; return_value is null while there is no result."""
    return requests.join(results.select("app", "id", "return_value"), ["app", "id"], "left")


def thread_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(app, pos, id, return_value) in request order."""
    return tasks.select("app", "id", "pos").join(results.select("app", "id", "return_value"), ["app", "id"], "left").select("app", "pos", "id", "return_value")


def frozen_apps(events: DataFrame) -> DataFrame:
    """Apps all of whose messages report frozen."""
    last = events.groupBy("app", "id").agg(F.max_by("return_value", "seq").alias("r"))
    return last.groupBy("app").agg(F.bool_and(F.col("r") == FROZEN).alias("frozen")).filter("frozen").select("app")


def slot_accounts(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, seq, used, violation) after each claim (+) or release (-) of (host, seq, slots): a violation is a use
    above the host's slots or below zero."""
    rows = prefix_sums(events, ["host"], ["seq"], "slots", "earlier").withColumn("used", F.col("earlier") + F.col("slots")).join(hosts.select("host", F.col("slots").alias("room")), "host")
    return rows.select("host", "seq", "used", ((F.col("used") > F.col("room")) | (F.col("used") < 0)).alias("violation"))
