"""Ordered messaging: numbered channels, delivery in sequence, routing and group completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows, running

CHANNEL = ["group", "src", "dst"]


def number_messages(messages: DataFrame, order: str = "sent") -> DataFrame:
    """messages with `seq`: their number in the channel, from 0."""
    return number_rows(messages, CHANNEL, [order], "seq").select(*messages.columns, "seq")


def deliver(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(delivered, held): of the messages that have arrived (seq, arrival), those up to the first gap of their channel,
    in order, with `ready`, the arrival that completes their prefix; the rest waits."""
    rows = running(messages.dropDuplicates([*CHANNEL, "seq"]), CHANNEL, ["seq"], {"_n": ("sum", F.lit(1).cast("long")), "ready": ("max", "arrival")})
    # Before the first gap all earlier messages are there, so the running maximum is that of the prefix.
    return rows.filter(F.col("seq") == F.col("_n") - 1).drop("_n"), rows.filter(F.col("seq") != F.col("_n") - 1).drop("_n", "ready")


def route(messages: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, errors): the host of each message's receiver by the latest mapping (group, idx, host, version)."""
    last = mappings.groupBy("group", "idx").agg(F.max_by("host", "version").alias("host"))
    rows = messages.join(last.withColumnRenamed("idx", "dst"), ["group", "dst"], "left")
    return rows.filter("host is not null"), rows.filter("host is null").drop("host")


def group_members(mappings: DataFrame) -> DataFrame:
    """(group, idxs, hosts) by the latest mapping."""
    last = mappings.groupBy("group", "idx").agg(F.max_by("host", "version").alias("host"))
    return last.groupBy("group").agg(F.sort_array(F.collect_set("idx")).alias("idxs"), F.sort_array(F.collect_set("host")).alias("hosts"))


def complete_groups(reports: DataFrame, sizes: DataFrame, main: int = 0) -> DataFrame:
    """(group, round, complete): all members but the main one have reported (group, round, idx)."""
    seen = reports.filter(F.col("idx") != main).groupBy("group", "round").agg(F.count_distinct("idx").alias("n"))
    return seen.join(sizes, "group").select("group", "round", (F.col("n") == F.col("size") - 1).alias("complete"))


def mappings_of(placements: DataFrame) -> DataFrame:
    """(group, members): placements (group, idx, host, app_idx) as one list per group."""
    return placements.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("idx", "host", "app_idx"))).alias("members"))


def placements_of(mappings: DataFrame) -> DataFrame:
    return mappings.select("group", F.inline("members"))
