"""Diff and merge of dataset versions that many workers change.

Datasets are long tables `cells(dataset, slot, value)`; regions (dataset, lo, len, op) say how changes to a range
of slots merge, with len 0 for "to the end". Interval joins go by page of slots, so they are equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.folds import UNSIGNED, product, unsigned_bits, unsigned_xor
from .intervals import PAGE, in_ranges
from .lineage import cut
from .ordering import merge_ranges

CELL = ["dataset", "slot"]
OPS = ("sum", "subtract", "product", "max", "min", "xor", "overwrite", "ignore")


def _merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Joins runs (keys, lo, hi; hi inclusive) that touch, within each group of the keys."""
    order = Window.partitionBy(*keys).orderBy("lo")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = runs.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def islands(cells: DataFrame, keys: list[str], fan: int = PAGE, levels: int = 2) -> DataFrame:
    """Maximal runs of consecutive slots: (keys, offset, length).

    Runs are built per page of `fan` slots; only runs that touch a page's edge go on to the next level, whose
    pages are `fan` times as long. So a window never holds a whole dataset, only its longest runs' edges."""
    runs, done, page = cells.select(*keys, F.col("slot").alias("lo"), F.col("slot").alias("hi")).distinct(), [], 1
    for _ in range(levels):
        page *= fan
        merged = _merge_runs(runs.withColumn("_page", F.expr(f"lo div {page}")), [*keys, "_page"])
        edge = (F.col("lo") == F.col("_page") * page) | (F.col("hi") == F.col("_page") * page + page - 1)
        done.append(merged.filter(~edge).drop("_page"))
        runs = merged.filter(edge).drop("_page")
    out = _merge_runs(runs, keys)
    for d in done:
        out = out.unionByName(d)
    return out.select(*keys, F.col("lo").alias("offset"), (F.col("hi") - F.col("lo") + 1).alias("length"))


def changed_runs(old: DataFrame, new: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Maximal runs of slots in [start, end) whose values differ: (dataset, offset, length)."""
    both = old.join(new.withColumnRenamed("value", "new"), CELL).filter(~F.col("value").eqNullSafe(F.col("new")))
    if start is not None:
        both = both.filter(F.col("slot") >= start)
    if end is not None:
        both = both.filter(F.col("slot") < end)
    return islands(both, ["dataset"])


def _quotient(new: Column, old: Column, kind: T.DataType) -> Column:
    """New over old, whole for whole types; null on a zero base."""
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.when(old != 0, F.call_function("div", new, old).cast(kind) if whole else new / old)


def typed_diff(pairs: DataFrame) -> DataFrame:
    """(dataset, slot, op, delta) from (dataset, slot, old, new, op), nothing where old and new agree.

    A product with a zero base has no quotient: its delta is null, and `no_quotient` tells such rows."""
    kind, old, new = pairs.schema["new"].dataType, F.col("old"), F.col("new")
    delta = (
        F.when(F.col("op") == "sum", new - old).when(F.col("op") == "subtract", old - new).when(F.col("op") == "product", _quotient(new, old, kind))
        .when(F.col("op").isin("max", "min", "overwrite"), new)
    )
    if _has_bits(kind):
        delta = delta.when(F.col("op") == "xor", _xor(old, new, kind))
    return pairs.filter(~old.eqNullSafe(new) & (F.col("op") != "ignore")).select(*CELL, "op", delta.cast(kind).alias("delta"))


def _has_bits(kind: T.DataType) -> bool:
    """Whole numbers of up to 64 bits, signed, or unsigned as decimals."""
    return isinstance(kind, (T.IntegerType, T.LongType)) or kind == UNSIGNED


def _xor(a: Column, b: Column, kind: T.DataType) -> Column:
    return unsigned_xor(a, b) if kind == UNSIGNED else a.bitwiseXOR(b)


def no_quotient(diffs: DataFrame) -> Column:
    """Whether a diff is a product without a factor."""
    return (F.col("op") == "product") & F.col("delta").isNull()


def _applied(old: Column, op: Column, d: Column, kind: T.DataType) -> Column:
    """The value after one diff. A product without a factor leaves it as it is."""
    new = (
        F.when(op == "sum", old + d).when(op == "subtract", old - d).when(op == "product", F.coalesce(old * d, old))
        .when(op == "max", F.greatest(old, d)).when(op == "min", F.least(old, d)).when(op == "overwrite", d)
    )
    return new.when(op == "xor", _xor(old, d, kind)) if _has_bits(kind) else new


def apply_diffs(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """base with at most one diff (dataset, slot, op, delta) per slot applied; slots beyond the base are added. A product
    without a factor (zero base) leaves the base as it is."""
    kind, old = base.schema["value"].dataType, F.col("value")
    new = _applied(old, F.col("op"), F.col("delta"), kind)
    return base.join(diffs, CELL, "full").select(*CELL, F.when(F.col("op").isNull(), old).otherwise(new).cast(kind).alias("value"))


def merge_overwrite(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """Slots take the value of their last diff by (worker, seq)."""
    last = diffs.groupBy(CELL).agg(F.max_by("value", F.struct("worker", "seq")).alias("new"))
    return base.join(last, CELL, "full").select(*CELL, F.coalesce("new", "value").alias("value"))


def fold_by_op(diffs: DataFrame) -> DataFrame:
    """Diffs (dataset, slot, op, delta, worker, seq) folded to one per slot and op: (dataset, slot, op, delta, n_diffs).
    One aggregation for batches and streams; products of whole numbers are exact."""
    kind, d, op = diffs.schema["delta"].dataType, F.col("delta"), F.col("op")
    folded = (
        F.when(op.isin("sum", "subtract"), F.sum(d)).when(op == "product", product(F.when(op == "product", d), kind)).when(op == "max", F.max(d))
        .when(op == "min", F.min(d)).when(op == "overwrite", F.max_by("delta", F.struct("worker", "seq")))
    )
    if _has_bits(kind):
        folded = folded.when(op == "xor", unsigned_bits(F.bit_xor, d) if kind == UNSIGNED else F.bit_xor(d))
    return diffs.groupBy(*CELL, "op").agg(folded.cast(kind).alias("delta"), F.count("*").alias("n_diffs"))


def fold_diffs(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The diffs folded to one per slot and op, and the slots (dataset, slot, ops) with more than one op, whose result
    depends on order: `merge_in_order` is for these."""
    return fold_by_op(diffs), diffs.groupBy(CELL).agg(F.count_distinct("op").alias("ops")).filter("ops > 1")


def merge_in_order(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """(dataset, slot, value) of the slots of the diffs (dataset, slot, op, delta, worker, seq): the base with all diffs
    of the slot applied one after the other by (worker, seq)."""
    kind = base.schema["value"].dataType
    steps = diffs.groupBy(CELL).agg(F.sort_array(F.collect_list(F.struct("worker", "seq", "op", "delta"))).alias("steps"))
    value = F.aggregate("steps", F.col("value"), lambda a, x: _applied(a, x["op"], x["delta"], kind).cast(kind))
    return steps.join(base, CELL, "left").select(*CELL, value.alias("value"))


def xor_merge(base: DataFrame, versions: DataFrame) -> DataFrame:
    """base xor all (old xor new) of the versions (dataset, slot, worker, value), in any order; whole numbers of up to 64
    bits, unsigned ones as decimal(20, 0)."""
    kind = base.schema["value"].dataType
    deltas = versions.withColumnRenamed("value", "new").join(base, CELL).select(*CELL, _xor(F.col("value"), F.col("new"), kind).alias("delta"))
    folded = deltas.groupBy(CELL).agg((unsigned_bits(F.bit_xor, F.col("delta")) if kind == UNSIGNED else F.bit_xor("delta")).alias("delta"))
    return base.join(folded, CELL, "left").select(*CELL, F.when(F.col("delta").isNull(), F.col("value")).otherwise(_xor(F.col("value"), F.col("delta"), kind)).alias("value"))


def sizes_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset").agg((F.max("slot") + 1).alias("size"))


def fill_gaps(regions: DataFrame, sizes: DataFrame, op: str = "overwrite") -> DataFrame:
    """The regions (dataset, lo, len, op) plus regions of `op` between them and after the last, up to the size;
    a dataset without regions gets one over everything. Length 0 reaches to the end."""
    order = Window.partitionBy("dataset").orderBy("lo", "hi")
    known = regions.join(sizes, "dataset").withColumn("hi", F.when(F.col("len") == 0, F.col("size")).otherwise(F.col("lo") + F.col("len")))
    seen = known.withColumn("before", F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    between = seen.filter("lo > before").select("dataset", F.col("before").alias("lo"), (F.col("lo") - F.col("before")).alias("len"))
    ends = sizes.join(known.groupBy("dataset").agg(F.max("hi").alias("hi")), "dataset", "left").withColumn("lo", F.coalesce("hi", F.lit(0)))
    after = ends.filter(F.col("hi").isNull() | (F.col("lo") < F.col("size"))).select("dataset", F.col("lo").cast("long").alias("lo"), F.lit(0).cast("long").alias("len"))
    return regions.select("dataset", "lo", "len", "op").unionByName(between.unionByName(after).withColumn("op", F.lit(op)))


def in_regions(cells: DataFrame, regions: DataFrame, sizes: DataFrame, page: int = PAGE, how: str = "inner") -> DataFrame:
    """Joins cells to the region (op, and its start as `region`) that holds them, to each one where regions overlap.
    Regions are clipped to the dataset's size, those past it skipped; they may be of any length (see `intervals`). how:
    inner, left_semi or left_anti."""
    clipped = regions.join(sizes, "dataset").select("dataset", "lo", F.least(F.when(F.col("len") == 0, F.col("size")).otherwise(F.col("lo") + F.col("len")), F.col("size")).alias("hi"), "op")
    return in_ranges(cells, clipped, ["dataset"], how=how, page=page).withColumnRenamed("lo", "region").drop("hi")


def drop_ignored(diffs: DataFrame, regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Diffs outside of the regions whose op is ignore."""
    return in_regions(diffs, regions.filter("op = 'ignore'"), sizes, how="left_anti")


def diff_regions(base: DataFrame, updated: DataFrame, regions: DataFrame, dirty: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """Diffs (dataset, slot, op, delta[, extra], region) of an updated version (dataset, slot, value[, extra]) under the
    regions, one for each region that holds the slot, with the region's start. Slots beyond the base's size are
    overwrites of no region (null); with `dirty` (dataset, page), clean pages are skipped."""
    extra, sizes = [*(extra or []), "region"], sizes_of(base)
    new = updated.withColumnRenamed("value", "new")
    if dirty is not None:
        pages = dirty.select(F.col("dataset").alias("_d"), F.col("page").alias("_p"))
        new = new.join(pages, (F.col("dataset") == F.col("_d")) & (F.expr(f"slot div {PAGE}") == F.col("_p")), "left_semi")
    both = new.join(base.withColumnRenamed("value", "old"), CELL, "left").join(sizes, "dataset", "left")
    grown = F.col("slot") >= F.coalesce("size", F.lit(0))
    growth = both.filter(grown).withColumn("region", F.lit(None).cast("long")).select(*CELL, *extra, F.lit("overwrite").alias("op"), F.col("new").alias("delta"))
    # Pairs that agree leave before the join with the regions.
    moved = in_regions(both.filter(~grown & ~F.col("old").eqNullSafe(F.col("new"))).drop("size"), regions, sizes)
    keyed = moved.withColumn("dataset", F.struct("dataset", *extra))
    diffs = typed_diff(keyed).select(F.col("dataset.dataset").alias("dataset"), "slot", *[F.col(f"dataset.{c}").alias(c) for c in extra], "op", "delta")
    return diffs.unionByName(growth)


def fork_join(base: DataFrame, versions: DataFrame, regions: DataFrame, op: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): the base after merging the workers' versions (dataset, worker, slot, value) by the regions, with
    `op` in the gaps. Slots of one op are folded by aggregation, whatever the number of workers; slots of overlapping
    regions of several ops take their diffs one after the other, by worker and then by the region's start. Products with
    a zero base change nothing and are rejects (dataset, slot, worker)."""
    diffs = cut(diff_regions(base, versions, fill_gaps(regions, sizes_of(base), op), extra=["worker"]).withColumnRenamed("region", "seq"))
    bad, good = diffs.filter(no_quotient(diffs)).select(*CELL, "worker"), diffs.filter(~no_quotient(diffs))
    folded, mixed = fold_diffs(good)
    mixed = cut(mixed.select(CELL))
    cells = apply_diffs(base, folded.join(mixed, CELL, "left_anti").drop("n_diffs"))
    ordered = merge_in_order(base, good.join(mixed, CELL, "left_semi"))
    return cells.join(mixed, CELL, "left_anti").unionByName(ordered), bad


def change_log(changes: DataFrame, clears: DataFrame) -> DataFrame:
    """Changes (dataset, version, lo, len) after the dataset's last clear (dataset, version), as merged ranges."""
    last = clears.groupBy("dataset").agg(F.max("version").alias("_v"))
    kept = changes.join(last, "dataset", "left").filter(F.col("_v").isNull() | (F.col("version") > F.col("_v")))
    merged = merge_ranges(kept.select("dataset", "lo", (F.col("lo") + F.col("len") - 1).alias("hi")), ["dataset"])
    return merged.select("dataset", F.col("lo").alias("offset"), (F.col("hi") - F.col("lo") + 1).alias("length"))


def mark_pages(writes: DataFrame, page: int = PAGE) -> DataFrame:
    """(dataset, worker, page) touched by writes (dataset, worker, slot)."""
    return writes.select("dataset", "worker", F.expr(f"slot div {page}").alias("page")).distinct()


def merge_page_flags(flags: DataFrame) -> DataFrame:
    """OR of the workers' flags (dataset, worker, page, dirty); the longest list sets the length."""
    return flags.groupBy("dataset", "page").agg(F.bool_or("dirty").alias("dirty"))


def page_align(ranges: DataFrame, page: int = PAGE) -> DataFrame:
    """Adds to ranges (offset, length): pages_up, pages_down, aligned_offset, aligned_length, remainder."""
    down = F.col("offset") - F.col("offset") % page
    return ranges.withColumns({
        "pages_up": F.expr(f"(length + {page - 1}) div {page}"), "pages_down": F.expr(f"length div {page}"), "aligned_offset": down,
        "remainder": F.col("offset") - down, "aligned_length": F.ceil((F.col("length") + F.col("offset") - down) / page) * page,
    })


def _xor_pages(pages: DataFrame) -> DataFrame:
    """(dataset, page, a, b) to (dataset, page, bytes = a xor b over the shorter length, then the rest of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = min(len(a), len(b))
                out.append((np.frombuffer(a[:n], np.uint8) ^ np.frombuffer(b[:n], np.uint8)).tobytes() + b[n:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["dataset", "page", "bytes"])

    kind = pages.schema["dataset"].dataType.simpleString()
    return pages.select("dataset", "page", "a", "b").mapInArrow(run, f"dataset {kind}, page long, bytes binary")


def hash_tree(pages: DataFrame, fan: int = 64) -> DataFrame:
    """(dataset, level, at, hash, length, zero) of paged bytes (dataset, page, bytes), to be kept with a version: level 0
    has a row per page, with its SHA-256 and whether it is all zero; level 1 one per `fan` pages, over their hashes."""
    zero = F.length(F.replace(F.hex("bytes"), F.lit("0"), F.lit(""))) == 0
    leaves = pages.select("dataset", F.lit(0).alias("level"), F.col("page").cast("long").alias("at"), F.sha2("bytes", 256).alias("hash"), F.length("bytes").cast("long").alias("length"), zero.alias("zero"))
    over = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["hash"])), ","), 256)
    groups = leaves.groupBy("dataset", F.expr(f"at div {fan}").alias("at")).agg(over.alias("hash"), F.sum("length").alias("length"), F.bool_and("zero").alias("zero"))
    return leaves.unionByName(groups.withColumn("level", F.lit(1)))


#: Rows (dataset, page) that are broadcast to find their pages; more are joined by a shuffle.
FEW_PAGES = 1_000_000


def changed_pages(old: DataFrame, new: DataFrame, page: int = PAGE, fan: int = 64) -> DataFrame:
    """(dataset, page, whole) of the pages of the hash tree `new` that a delta from `old` has to name: those with another
    hash, or short in one of them, or beyond the old end and not all zero. whole: as long as a page in both. Groups of
    pages with one hash and whole pages only are left out before their pages are looked at."""
    ends = ["dataset", "at"]
    groups = new.filter("level = 1").join(old.filter(f"level = 1 and length = {page * fan}").select(*ends, F.col("hash").alias("_was")), ends, "left")
    open_ = groups.filter("_was is null or _was <> hash").select("dataset", F.col("at").alias("_group"))
    below = lambda tree: tree.filter("level = 0").withColumn("_group", F.expr(f"at div {fan}")).join(open_, ["dataset", "_group"], "left_semi")
    was = below(old).select(*ends, F.col("hash").alias("_was"), F.col("length").alias("_long"))
    both = below(new).join(was, ends, "left")
    whole = F.coalesce((F.col("length") == page) & (F.col("_long") == page), F.lit(False))
    named = F.when(F.col("_was").isNull(), ~F.col("zero")).otherwise(~whole | (F.col("hash") != F.col("_was")))
    return both.filter(named).select("dataset", F.col("at").alias("page"), whole.alias("whole"))


def paged_delta(old: DataFrame, new: DataFrame, xor: bool = True, page: int = PAGE, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Delta (dataset, page, kind, bytes, size) of paged versions (dataset, page, bytes): XOR or OVERWRITE rows for
    changed pages that are whole in both, OVERWRITE for pages that are short in one of them and for pages beyond the old
    end that are not all zero, one SIZE row per dataset.

    Hash trees are compared first (`trees`, if they were kept with the versions); only pages that they name are fetched
    and joined, so the bytes of equal pages are not shuffled, unless more than FEW_PAGES change."""
    trees = trees or (cut(hash_tree(old)), cut(hash_tree(new)))
    named = cut(changed_pages(*trees, page))
    few = F.broadcast(named) if named.count() <= FEW_PAGES else named
    b = new.join(few, ["dataset", "page"]).withColumnRenamed("bytes", "b")
    a = old.join(few.filter("whole").select("dataset", "page"), ["dataset", "page"], "left_semi").withColumnRenamed("bytes", "a")
    if xor:
        moved = _xor_pages(b.filter("whole").join(a, ["dataset", "page"])).select("dataset", "page", F.lit("XOR").alias("kind"), "bytes")
        other = b.filter("not whole")
        moved = moved.unionByName(other.select("dataset", "page", F.lit("OVERWRITE").alias("kind"), F.col("b").alias("bytes")))
    else:
        moved = b.select("dataset", "page", F.lit("OVERWRITE").alias("kind"), F.col("b").alias("bytes"))
    size = trees[1].filter("level = 1").groupBy("dataset").agg(F.sum("length").alias("size")).select("dataset", F.lit(None).cast("long").alias("page"), F.lit("SIZE").alias("kind"), F.lit(None).cast("binary").alias("bytes"), "size")
    return moved.withColumn("size", F.lit(None).cast("long")).unionByName(size)


def cell_page_hashes(cells: DataFrame, page: int = PAGE) -> DataFrame:
    """(dataset, page, n, h, g) of cells (dataset, slot, value), to be kept with a version: their number and 128 bits over
    slots and values, in any order."""
    return cells.groupBy("dataset", F.expr(f"slot div {page}").alias("page")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("slot", "value")).alias("h"), F.bit_xor(F.xxhash64(F.lit("g"), "value", "slot")).alias("g"))


def dirty_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dataset, page) of the page hashes `new` that `old` has not: the `dirty` that lets diff_regions skip all others."""
    return new.join(old, ["dataset", "page", "n", "h", "g"], "left_anti").select("dataset", "page")


def apply_paged_delta(old: DataFrame, delta: DataFrame, page: int = PAGE) -> DataFrame:
    """The new pages: delta applied to the old pages, cut or filled with zeros to the delta's size."""
    size = delta.filter("kind = 'SIZE'").select("dataset", "size")
    pages = size.filter("size > 0").select("dataset", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {page}"))).alias("page"))
    rows = pages.join(old, ["dataset", "page"], "left").join(delta.filter("kind <> 'SIZE'").select("dataset", "page", "kind", F.col("bytes").alias("d")), ["dataset", "page"], "left")
    want = F.least(F.lit(page), F.col("size") - F.col("page") * page).cast("int")
    zeros = F.lit(bytes(page))
    fit = lambda x: F.substring(F.concat(F.coalesce(x, F.lit(b"")), zeros), F.lit(1), want)
    xored = rows.filter("kind = 'XOR'").select("dataset", "page", F.substring(F.concat("bytes", zeros), F.lit(1), F.length("d")).alias("a"), F.col("d").alias("b"), want.alias("want"))
    xored = _xor_pages(xored)
    plain = rows.filter("kind is null or kind = 'OVERWRITE'").select("dataset", "page", fit(F.coalesce("d", "bytes")).alias("bytes"))
    return plain.unionByName(xored)


def restore(versions: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): each dataset takes the content of its snapshot (dataset, version, max_size) from the
    versioned cells; a snapshot that is larger than max_size is rejected."""
    held = versions.join(snapshots, ["dataset", "version"])
    size = held.groupBy("dataset", "version").agg((F.max("slot") + 1).alias("size"), F.max("max_size").alias("max_size"))
    bad = size.filter("size > max_size")
    return held.join(bad, ["dataset", "version"], "left_anti").select("dataset", "slot", "value"), bad
