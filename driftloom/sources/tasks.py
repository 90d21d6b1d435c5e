"""Sources and sinks of tasks: JSON batches, occupancy files, generated batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows

MESSAGE = ("id: int, appIdx: int, type: int, user: string, function: string, input_data: string, output_data: string, returnValue: int, start_ts: bigint, finish_ts: bigint, "
           "groupId: int, groupIdx: int, groupSize: int, mpi: boolean, mpiRank: int, mpi_world_size: int, record_exec_graph: boolean, chainedMsgIds: array<int>")
BATCH = f"appId int, groupId int, user string, function string, type int, messages array<struct<{MESSAGE}>>, _corrupt string"


def parse_batches(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(tasks, rejects) of JSON batch requests, one per row. Malformed JSON goes to rejects (value)."""
    parsed = lines.select(F.col(column).alias("value"), F.from_json(F.col(column), BATCH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("b"))
    bad = F.col("b").isNull() | F.col("b._corrupt").isNotNull()
    good = parsed.filter(~bad).select(F.col("b.appId").alias("app"), F.col("b.groupId").alias("group"), F.col("b.user").alias("batch_user"), F.posexplode("b.messages").alias("pos", "m"))
    return good.select("app", "group", "batch_user", "pos", "m.*"), parsed.filter(bad).select("value")


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_batches(spark.read.text(path))


def message_json(*columns: str | Column) -> Column:
    """A message as JSON text; enums are integers, keys have their names on the wire, nulls are left out."""
    return F.to_json(F.struct(*columns))


def write_json(messages: DataFrame, path: str) -> None:
    """The JSON sink: one message a line, columns by their names on the wire, nulls left out."""
    messages.select(F.to_json(F.struct(*messages.columns)).alias("value")).write.text(path)


def _occupancy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, placements) of lines (file, block, at, text), which (block, at) orders within a file."""
    heads = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("_head"))
    body = lines.join(heads, "file", "left").filter("(_head is null or block > 0 or at > _head) and text <> ''")
    cells = F.split("text", ",")
    slots = body.select("file", "block", "at", F.get(cells, F.lit(0)).alias("host"), F.posexplode_outer(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).alias("slot", "app"))
    slots = slots.withColumn("app", F.col("app").cast("int"))
    hosts = slots.groupBy("file", "host").agg(F.count("app").alias("slots"), F.count_if(F.col("app") != -1).alias("used"))
    taken = number_rows(slots.filter("app <> -1"), ["file", "app"], ["block", "at", "slot"], "pos")
    return hosts, taken.select("file", "app", F.col("pos").cast("int").alias("pos"), "host")


def parse_occupancy(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, placements) of occupancy files (file, value): after a header, each line has a host and one app per slot,
    -1 for an empty one. hosts: (file, host, slots, used); placements: (file, app, pos, host), numbered per app in
    file order."""
    return _occupancy(files.select("file", F.lit(0).alias("block"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text")))


def occupancy_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text) of the lines of files, read by blocks: a large file is read by many tasks. Blocks start at
    their byte in the file; `at` ascends within what a task reads, so (block, at) is the order of the file."""
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text"))


def read_occupancy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As parse_occupancy, of files; an app's placements in a file are numbered in ranges, however many there are."""
    return _occupancy(occupancy_lines(spark, path))


def generate_tasks(batches: DataFrame) -> DataFrame:
    """Tasks (app, app_idx, user, function) of batches (app, user, function, count)."""
    return batches.filter(F.col("count") > 0).select("app", F.explode(F.expr("sequence(0, cast(count as int) - 1)")).alias("app_idx"), "user", "function")
