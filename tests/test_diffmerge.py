"""Exact cases of diff and merge, and laws that they keep."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import diffmerge as m

CELLS = "dataset string, slot long, value long"


def cells(spark, values, name="d"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], CELLS)


@pytest.mark.parametrize("old,new,lo,hi,runs", [
    ("0022334455", "0112366655", 0, 10, [(1, 2), (5, 3)]),
    ("00000011000000", "11111001111100", 3, 10, [(3, 2), (6, 1), (8, 2)]),
    ("01234", "01334", 0, 5, [(2, 1)]),
    ("0123456", "1233346", 0, 7, [(0, 3), (4, 2)]),
    ("0123456", "0113345", 0, 7, [(2, 1), (4, 3)]),
])
def test_changed_runs(spark, old, new, lo, hi, runs):
    out = m.changed_runs(cells(spark, map(int, old)), cells(spark, map(int, new)), lo, hi)
    assert sorted((r.offset, r.length) for r in out.collect()) == runs


def test_islands_across_pages(spark):
    slots = [*range(0, 10), *range(12, 40), 63, 64, 65, *range(100, 164)]
    df = spark.createDataFrame([("d", s) for s in slots], "dataset string, slot long")
    out = m.islands(df, ["dataset"], fan=4, levels=2)
    assert sorted((r.offset, r.length) for r in out.collect()) == [(0, 10), (12, 28), (63, 3), (100, 64)]


def test_typed_diffs(spark):
    rows = [("d", 0, 123456, 150000, "sum"), ("d", 4, 300000, 650123, "sum"), ("d", 8, 150, 100, "subtract"), ("d", 9, 5, 5, "sum"), ("d", 10, 0, 5, "product"), ("d", 11, 3, 7, "product"), ("d", 12, 1, 2, "ignore")]
    out = m.typed_diff(spark.createDataFrame(rows, "dataset string, slot long, old long, new long, op string")).orderBy("slot").collect()
    assert [(r.slot, r.delta) for r in out] == [(0, 26544), (4, 350123), (8, 50), (10, None), (11, 2)]


@pytest.mark.parametrize("regions,expected", [
    ([], [(0, 0)]), ([(0, 100)], [(100, 0)]), ([(12288 - 100, 100)], [(0, 12288 - 100)]), ([(0, 100), (100, 50)], [(150, 0)]), ([(0, 0)], []),
])
def test_fill_gaps(spark, regions, expected):
    df = spark.createDataFrame([("d", a, b, "sum") for a, b in regions], "dataset string, lo long, len long, op string")
    sizes = spark.createDataFrame([("d", 12288)], "dataset string, size long")
    assert sorted((r.lo, r.len) for r in m.fill_gaps(df, sizes, "xor").filter("op = 'xor'").collect()) == expected


@pytest.mark.parametrize("a,b,merged", [("010110", "011010", "011110"), ("0101", "011001", "011101"), ("010110", "0110", "011110")])
def test_merge_page_flags(spark, a, b, merged):
    rows = [("d", w, p, f == "1") for w, flags in enumerate((a, b)) for p, f in enumerate(flags)]
    out = m.merge_page_flags(spark.createDataFrame(rows, "dataset string, worker int, page long, dirty boolean")).orderBy("page").collect()
    assert "".join(str(int(r.dirty)) for r in out) == merged


@pytest.mark.parametrize("xor", [True, False])
def test_paged_delta_round_trip(spark, xor):
    old = bytes(10000) + bytes([17]) * 10000 + bytes([37]) * 10000 + bytes(35536)
    new = bytearray(old) + bytes(65536)
    new[15000:19000], new[29000:32000], new[100000:129000] = bytes([12]) * 4000, bytes([99]) * 3000, bytes([127]) * 29000
    pages = lambda b: spark.createDataFrame([("d", i // 4096, bytes(b[i : i + 4096])) for i in range(0, len(b), 4096)], "dataset string, page long, bytes binary")
    for a, b in ((old, new), (bytes(new), old), (old, old[:5000])):
        delta = m.paged_delta(pages(a), pages(b), xor)
        back = m.apply_paged_delta(pages(a), delta).orderBy("page").collect()
        assert b"".join(bytes(r.bytes) for r in back) == bytes(b)
    assert m.paged_delta(pages(old), pages(new), xor).filter("page > 16 and kind <> 'SIZE'").count() == 8  # all-zero new pages are left out


def test_fork_join(spark):
    base = cells(spark, [10, 20, 30, 40, 50, 60])
    rows = [("d", w, s, v) for w, changed in enumerate(([15, 20, 33, 40, 51, 60], [12, 25, 30, 44, 50, 60])) for s, v in enumerate(changed)] + [("d", 1, 6, 99)]
    versions = spark.createDataFrame(rows, "dataset string, worker int, slot long, value long")
    regions = spark.createDataFrame([("d", 0, 2, "sum"), ("d", 2, 2, "max"), ("d", 4, 1, "ignore")], "dataset string, lo long, len long, op string")
    out, rejects = m.fork_join(base, versions, regions)
    assert [r.value for r in out.orderBy("slot").collect()] == [17, 25, 33, 44, 50, 60, 99] and rejects.isEmpty()


def test_products_of_a_zero_base_are_rejects(spark):
    base = cells(spark, [0, 3, 0])
    versions = spark.createDataFrame([("d", w, s, v) for w, values in ((5, (0, 6, 0)), (6, (6, 9, 0))) for s, v in enumerate(values)], "dataset string, worker int, slot long, value long")
    regions = spark.createDataFrame([("d", 0, 3, "product")], "dataset string, lo long, len long, op string")
    out, rejects = m.fork_join(base, versions, regions)
    assert [r.value for r in out.orderBy("slot").collect()] == [0, 18, 0]
    assert [(r.slot, r.worker) for r in rejects.collect()] == [(0, 6)]


def test_overlapping_regions_apply_in_order(spark):
    base = cells(spark, [10, 20, 30, 40])
    versions = spark.createDataFrame([("d", w, s, v) for w, values in enumerate(((10, 20, 35, 41), (10, 20, 31, 48))) for s, v in enumerate(values)], "dataset string, worker int, slot long, value long")
    regions = spark.createDataFrame([("d", 0, 3, "sum"), ("d", 2, 2, "max")], "dataset string, lo long, len long, op string")
    out, _ = m.fork_join(base, versions, regions)
    # Slot 2: 30 + 5, then max with 35; then + 1, then max with 31. Slot 3 is max alone.
    assert [(r.slot, r.value) for r in out.orderBy("slot").collect()] == [(0, 10), (1, 20), (2, 36), (3, 48)]


def test_products_are_exact(spark):
    rows = [("d", 0, "product", v, i, 0) for i, v in enumerate((3037000501, 3000000019))] + [("d", 1, "product", v, i, 0) for i, v in enumerate((-1, 1, 7, -1, -1))] + [("d", 2, "product", v, i, 0) for i, v in enumerate((0, 9, 9))]
    diffs = spark.createDataFrame(rows, "dataset string, slot long, op string, delta long, worker int, seq int")
    assert {r.slot: r.delta for r in m.fold_by_op(diffs).collect()} == {0: 3037000501 * 3000000019, 1: -7, 2: 0}


def test_change_log_merges_ranges(spark):
    changes = spark.createDataFrame([(k, v, lo, n) for k in ("d", None) for v, lo, n in ((1, 0, 2), (3, 5, 3), (4, 5, 3), (5, 7, 4), (6, 20, 1), (7, 21, 1))], "dataset string, version int, lo long, len long")
    clears = spark.createDataFrame([("d", 2)], "dataset string, version int")
    out = sorted((str(r.dataset), r.offset, r.length) for r in m.change_log(changes, clears).collect())
    assert out == [("None", 0, 2), ("None", 5, 6), ("None", 20, 2), ("d", 5, 6), ("d", 20, 2)]


def test_diff_then_apply_is_the_new_version(spark):
    a, b = cells(spark, [1, 2, 3, 4, 5]), cells(spark, [1, 7, 3, 0, 9, 8])
    regions = spark.createDataFrame([("d", 0, 2, "sum"), ("d", 2, 2, "xor")], "dataset string, lo long, len long, op string")
    out = m.apply_diffs(a, m.diff_regions(a, b, m.fill_gaps(regions, m.sizes_of(a))).drop("region"))
    assert out.exceptAll(b).isEmpty() and b.exceptAll(out).isEmpty()


def test_mixed_ops_are_reported(spark):
    diffs = spark.createDataFrame([("d", 1, "sum", 5, 0, 0), ("d", 1, "max", 5, 1, 0), ("d", 2, "product", 3, 0, 0), ("d", 2, "product", 4, 1, 0)], "dataset string, slot long, op string, delta long, worker int, seq int")
    folded, mixed = m.fold_diffs(diffs)
    assert folded.filter("slot = 2").first().delta == 12
    assert [(r.slot, r.ops) for r in mixed.collect()] == [(1, 2)]


def test_restore_rejects_growth(spark):
    v = cells(spark, [1, 2, 3]).withColumn("version", F.lit(4))
    snaps = spark.createDataFrame([("d", 4, 2)], "dataset string, version int, max_size long")
    kept, bad = m.restore(v, snaps)
    assert kept.isEmpty() and bad.first().size == 3
