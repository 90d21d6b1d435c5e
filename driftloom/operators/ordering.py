"""Running sums, extremes, numbers and ordered folds in groups of any size.

A window per group puts a group into one task. Here rows are dealt by ranges of (keys, order), so a large group
spreads over many tasks; results per range are ordered (a few rows a group), then each range adds what came before.
Keys may be null: rows with a null key are a group like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .lineage import cut

#: Aggregates that can be carried from range to range, and how two of them meet.
CARRIED: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)), "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple], inclusive: bool = True) -> DataFrame:
    """df with running aggregates over the rows of the group (keys) up to this one by `order`, or before it if not
    inclusive. outs: name -> (sum, max or min, column). A sum over no rows is 0, an extreme null. Rows that `order` does
    not tell apart stand in any order."""
    # The ranges are cut into a table, so that both uses below see the same ones.
    named = {f"__v{i}": F.col(c) if isinstance(c, str) else c for i, (_, c) in enumerate(outs.values())}
    dealt = cut(df.withColumns(named).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ranges = dealt.groupBy(*keys, "__range").agg(*[CARRIED[kind][0](f"__v{i}").alias(f"__r{i}") for i, (kind, _) in enumerate(outs.values())])
    ranges = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"),
                           *[CARRIED[kind][0](f"__r{i}").over(earlier).alias(f"__b{i}") for i, (kind, _) in enumerate(outs.values())])
    rows = dealt.select("*", *[CARRIED[kind][0](f"__v{i}").over(within).alias(f"__w{i}") for i, (kind, _) in enumerate(outs.values())])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__range") == F.col("__at"))
    found = rows.join(ranges, on)
    return found.select(*[c for c in df.columns if c not in outs], *[CARRIED[kind][1](F.col(f"__b{i}"), F.col(f"__w{i}")).alias(out) for i, (out, (kind, _)) in enumerate(outs.items())])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the group that come before by `order`."""
    return running(df, keys, order, {out: ("sum", value)}, inclusive=False).withColumn(out, F.col(out).cast("long"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with `out`: the row's number in its group, from 0. Ranges are sorted, not held: a row's place in its range, less
    that of the group's first row there, is added to the group's rows in the ranges before."""
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = cut(rows.withColumns({"__range": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    ranges = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__range") == F.col("__at"))
    return dealt.join(ranges, on).select(*[c for c in df.columns if c != out], (F.col("__pos") + F.col("__base")).alias(out))


#: How many copies of a row are made in one go.
COPIES = 65_536


def repeat(df: DataFrame, times: str, deal: bool = False) -> DataFrame:
    """Each row as often as `times` says (not at all below 1), without that column. With `deal`, rows with many copies
    are dealt over all tasks, in parts, before they are copied."""
    rest = [c for c in df.columns if c != times]
    parts = df.filter(F.col(times) > 0).withColumn("__i", F.explode(F.expr(f"sequence(0L, (cast(`{times}` as long) - 1) div {COPIES})")))
    parts = parts.repartition(F.col("__i"), *rest) if deal else parts
    here = F.least(F.col(times) - F.col("__i") * COPIES, F.lit(COPIES)).cast("long")
    return parts.withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), here))).select(*rest)


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, lo, hi; hi inclusive) that overlap or touch as one, in groups of any size."""
    rows = running(ranges.select(*keys, "lo", "hi").distinct(), keys, ["lo", "hi"], {"_upto": ("max", "hi")}, inclusive=False)
    fresh = F.coalesce(F.col("lo") > F.col("_upto") + 1, F.lit(True)).cast("long")
    rows = running(rows, keys, ["lo", "hi"], {"_run": ("sum", fresh)})
    return rows.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of `schema` from fold(key, rows) of each key, whose rows (the other columns as tuples) come one by one in
    order. Partitions are sorted and read as a stream, so a key's rows are never held together."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    n, arrow = len(keys), to_arrow_schema(T.StructType.fromDDL(schema))

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out: list[tuple] = []
        for key, group in groupby(stream, key=lambda row: row[:n]):
            for row in fold(key, (r[n:] for r in group)):
                out.append(row)
                if len(out) >= 10_000:
                    yield made(out)
                    out = []
        yield made(out)

    return rows.mapInArrow(run, schema)


def scan_ranges(df: DataFrame, keys: list[str], order: list[str], summary: Callable[[Iterator[tuple]], object], emit: Callable[[tuple, object, Iterator[tuple]], Iterator[tuple]],
                start: object, schema: str) -> DataFrame:
    """Rows of `schema` from emit(key, state, rows): an ordered fold whose state passes from row to row, in groups of any
    size. Rows (the columns but keys, as tuples) are dealt by ranges of (keys, order). Each range is first put into a
    summary, whose apply(state) gives the state after the range from the one before; the summaries of a key are applied
    in order, from `start`; then all ranges run at once, each from its own state."""
    rest, at = [c for c in df.columns if c not in keys], [*keys, "__range"]
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def put(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield *key, pickle.dumps(summary(rows))

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = start
        for where, data in rows:
            yield *key, where, pickle.dumps(state)
            state = pickle.loads(data).apply(state)

    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = pickle.loads(next(rows)[1])
        yield from emit(key[:-1], state, (row[2:] for row in rows))

    summaries = fold_sorted(dealt, at, order, put, f"{kinds}, __range int, __state binary")
    states = fold_sorted(summaries, keys, ["__range"], walk, f"{kinds}, __range int, __state binary")
    heads = states.select(*at, F.lit(0).alias("__later"), "__state", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest])
    rows = dealt.select(*at, F.lit(1).alias("__later"), F.lit(None).cast("binary").alias("__state"), *rest)
    return fold_sorted(heads.union(rows), at, ["__later", *order], run, schema)


def combine(df: DataFrame, keys: list[str], value: str, function: Callable, schema: str, order: list[str] | None = None, held: int = 50_000) -> DataFrame:
    """(keys, value) by an associative function of two values, nulls left out. Without an order, a task combines what it
    reads for up to `held` keys at a time; with one, rows are dealt by ranges of (keys, order), and a task combines each
    run of a key. What is shuffled then is a partial result a task and key, combined again in order."""
    n, arrow = len(keys), to_arrow_schema(T.StructType.fromDDL(schema))
    partial = T.StructType.fromDDL(schema).add("__at", T.LongType())
    out_schema = to_arrow_schema(partial)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, *(order or []))
    if order:
        rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = {}, TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            nonlocal at
            columns = [*zip(*[(*key, x) for key, x in found.items()])] or [[] for _ in arrow]
            at += 1
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip([*columns, [at] * len(found)], out_schema)], schema=out_schema)
            found.clear()
            return batch

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns[: n + 1]]):
                key, x = row[:n], row[n]
                found[key] = function(found[key], x) if key in found else x
                if len(found) >= held:
                    yield made()
        yield made()

    def fold(key: tuple, parts: Iterator[tuple]) -> Iterator[tuple]:
        yield *key, reduce(function, (x for x, _ in parts))

    return fold_sorted(rows.mapInArrow(run, partial), keys, ["__at"], fold, schema)
