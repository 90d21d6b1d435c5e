"""User functions over tables of tasks, with failures kept to the task that failed.

Functions get one task as a dict and return a return value, or (return value, output). They run in the tasks'
own partitions in Arrow batches; Spark retries lost executors, so functions must be free of side effects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .diffmerge import fork_join
from .graph import cycle_nodes
from .intervals import in_ranges
from .lineage import cut
from .ordering import repeat

#: Tasks that stand in memory as Python objects at a time; tasks may carry long texts.
HELD = 64

RESULT = "app long, id long, return_value int, output string"


def call(function: Callable | None, name: str, task: dict) -> tuple[int, str]:
    """Return value and output; an exception gives return value 1 and its text, as does an unknown function."""
    if function is None:
        return 1, f"unknown function {name}"
    try:
        got = function(task)
    except Exception as error:  # the task's failure is its result
        return 1, str(error)
    return (int(got[0]), str(got[1])) if isinstance(got, tuple) else (int(got), "")


def dispatch(tasks: DataFrame, functions: dict[str, Callable], column: str = "function") -> DataFrame:
    """(app, id, return_value, output): each task (app, id, function, ...) by the function of its name. Tasks of
    different functions may be mixed; unknown names fail only their own tasks."""

    out = to_arrow_schema(T.StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD):
                rows = batch.slice(lo, HELD).to_pylist()
                found = [(r["app"], r["id"], *call(functions.get(r[column]), r[column], r)) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), out)], schema=out)

    return tasks.mapInArrow(run, RESULT)


def run_tasks(tasks: DataFrame, function: Callable) -> DataFrame:
    """One function over all tasks."""
    return dispatch(tasks.withColumn("_function", F.lit("it")), {"it": function}, "_function")


def fork_join_tasks(tasks: DataFrame, base: DataFrame, regions: DataFrame, function: Callable, op: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) as from fork_join: the base cells (dataset, slot, value) after each task (dataset, worker, lo, hi)
    changed its slots [lo, hi) and the changes were merged by the regions. function(task, slots, values) returns the
    new values; a worker sees the base, not what others did. A task's slots meet in one call, so large datasets are
    given as many tasks of bounded ranges."""
    kind = base.schema["value"].dataType.simpleString()
    name = base.schema["dataset"].dataType.simpleString()
    held = in_ranges(base, tasks.select("dataset", "worker", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")), ["dataset"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        task = pdf.iloc[0][["dataset", "worker", "lo", "hi"]].to_dict()
        return pd.DataFrame({"dataset": pdf["dataset"], "worker": pdf["worker"], "slot": pdf["slot"], "value": function(task, pdf["slot"].to_numpy(), pdf["value"].to_numpy())})

    versions = held.groupBy("dataset", "worker", "lo", "hi").applyInPandas(run, f"dataset {name}, worker long, slot long, value {kind}")
    return fork_join(base, versions, regions, op)


def run_chained(tasks: DataFrame, function: Callable, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, calls) of tasks (app, id, depth) whose function returns (return value, output, child ids): children
    run in the next round, edges go to calls (app, parent_id, child_id). Rounds go on until no task calls another one. A
    task that is called from below itself would never end: it is an error that names it, as soon as it is called again.
    A function that keeps inventing new ids ends at max_rounds, if that is set, with an error.

    A task that is called several times at one depth stands that often in the results and its calls, but its function runs
    once for them: what it returns may depend on the task alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for task in pdf.to_dict("records"):
                at = task["app"], task["id"], task["depth"], task.pop("n")
                try:
                    value, output, children = function(task)
                except Exception as error:
                    value, output, children = 1, str(error), []
                rows.append((*at, int(value), str(output), [int(c) for c in children]))
            yield pd.DataFrame(rows, columns=["app", "id", "depth", "n", "return_value", "output", "children"])

    rounds, now = [], tasks.groupBy("app", "id").agg(F.count("*").alias("n")).withColumn("depth", F.lit(0))
    edges = lambda rows: rows.select("app", F.col("id").alias("parent_id"), F.explode("children").alias("child_id"))
    while True:
        # What is called n times at a depth runs once there, and its result counts n times.
        done = cut(now.select("app", "id", "depth", "n").mapInPandas(run, "app long, id long, depth int, n long, return_value int, output string, children array<bigint>"))
        rounds.append(done)
        now = done.select("app", F.explode("children").alias("id"), (F.col("depth") + 1).alias("depth"), "n").groupBy("app", "id", "depth").agg(F.sum("n").alias("n"))
        if now.isEmpty():
            break
        if max_rounds is not None and len(rounds) >= max_rounds:
            raise ValueError(f"tasks are chained over more than {max_rounds} rounds")
        rows = reduce(DataFrame.union, rounds)
        # Only a task that has run before can close a cycle, and only where some calls go up and some down.
        if not now.join(rows.select("app", "id"), ["app", "id"], "left_semi").isEmpty() and not _one_way(edges(rows)):
            bad = cycle_nodes(edges(rows)).orderBy("app", "id").limit(10).collect()
            if bad:
                raise ValueError("tasks call themselves, at " + ", ".join(f"task {r.id} of app {r.app}" for r in bad))
    rows = reduce(DataFrame.union, rounds)
    called = rows.select("app", "n", F.col("id").alias("parent_id"), F.explode("children").alias("child_id"))
    return repeat(rows.select("app", "id", "depth", "return_value", "output", "n"), "n", deal=True), repeat(called.select("app", "parent_id", "child_id", "n"), "n", deal=True)


def _one_way(edges: DataFrame) -> bool:
    """Whether all calls go to larger numbers, or all to smaller ones, so that there is no cycle."""
    up, down = edges.agg(F.bool_or(F.col("child_id") >= F.col("parent_id")), F.bool_or(F.col("child_id") <= F.col("parent_id"))).first()
    return not (up and down)
