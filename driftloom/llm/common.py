"""What the operators of this subpackage share: words, shared scratch tables, hot-group prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lineage

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths given out within each `finished` that is under way in this thread.
_GIVEN: ContextVar[tuple[list[str], ...]] = ContextVar("_GIVEN", default=())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there goes with the driver, if not before."""
    path = lineage.scratch(spark, name)
    for given in _GIVEN.get()[-1:]:
        given.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() as a table in the shared folder, after which all that it wrote there on the way is deleted."""
    given: list[str] = []
    before = _GIVEN.set((*_GIVEN.get(), given))
    try:
        out = cut(make(), name)
    finally:
        _GIVEN.reset(before)
    for path in given[:-1]:  # the last one is out
        _delete(out.sparkSession, path)
    return out


def cut(df: DataFrame, name: str = "table", small: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which ends its lineage:
    losing an executor later costs no recomputation of what came before.

    Joins with the table sort and merge at every size, so that a plan that is seen on little data is the plan on
    much; `small` leaves the choice to Spark, for tables of a row per source or the like."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written if small else written.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` has written and that no later plan reads."""
    for table_ in tables:
        spark = table_.sparkSession
        for folder in {name.rpartition("/")[0] for name in table_.inputFiles()[:1]}:
            if "/driftloom-" in folder:
                _delete(spark, folder)


def n_words(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before, in the order
    (bucket, *order). A group may hold any share of all rows: sums are taken per (group, bucket), which is
    spread over tasks, and only the sums of a group's buckets are ordered together."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over_buckets = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_sum").over(over_buckets), F.lit(0)).alias("_before"),
    )
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col(bucket) == F.col("_b")]
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, on)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_before", "_b", *[f"_g{i}" for i in range(len(group))])
    )


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that a task holds few rows as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
