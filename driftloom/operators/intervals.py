"""Joins of slots to the ranges that hold them, as equi-joins, for ranges of any length.

A range is covered by aligned blocks: pages at its edges, and between them blocks of FAN pages, FAN pages squared and so
on, each as large as fits. That is at most 2 * FAN blocks a level and a few levels, however long the range is. A slot
looks in the one block of each level that holds it, for the levels that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, FAN, LEVELS = 4096, 64, 9


def _blocks(lo: Column, hi: Column, page: int) -> Column:
    """Array of (level, block) that covers [lo, hi) without overlap; lo < hi."""
    at, parts = [], []
    div = lambda a, n: F.call_function("div", a, F.lit(n).cast("long"))
    for k in range(LEVELS):
        size = page * FAN**k
        if size >= 1 << 62:
            break
        # Whole blocks of this level: [first, last). A slot is below 2 ** 62, which keeps the sums within a long.
        at.append((div(lo + (size - 1), size), div(hi, size)))
    span = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("_level"), x.alias("_block")))).otherwise(F.array())
    first_page, last_page = div(lo, page), div(hi - 1, page)
    edge = lambda c, when: F.when(when, F.array(F.struct(F.lit(0).alias("_level"), c.alias("_block")))).otherwise(F.array())
    parts += [edge(first_page, lo % page != 0), edge(last_page, (hi % page != 0) & ((first_page != last_page) | (lo % page == 0)))]
    for k, (a, b) in enumerate(at):
        if k + 1 < len(at):
            up_a, up_b = (x * FAN for x in at[k + 1])
            wider = at[k + 1][0] < at[k + 1][1]
            parts += [span(k, a, F.when(wider, up_a).otherwise(b)), span(k, F.when(wider, up_b).otherwise(b), b)]
        else:
            parts.append(span(k, a, b))
    return F.flatten(F.array(*parts))


def cover(ranges: DataFrame, page: int = PAGE) -> DataFrame:
    """The ranges (lo, hi; hi exclusive, ...), once for each of their blocks (_level, _block); empty ranges have none."""
    rows = ranges.filter("lo < hi").withColumns({"lo": F.col("lo").cast("long"), "hi": F.col("hi").cast("long")})
    return rows.withColumn("_b", F.explode(_blocks(F.col("lo"), F.col("hi"), page))).select("*", "_b._level", "_b._block").drop("_b")


def in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], slot: str = "slot", how: str = "inner", page: int = PAGE) -> DataFrame:
    """rows (keys, slot, ...) joined to each range (keys, lo, hi; hi exclusive, ...) of their keys that holds their slot;
    how: inner, or left_semi or left_anti for the rows that some range or no range holds."""
    covered = cover(ranges, page)
    # At most LEVELS numbers; most tables of ranges have one or two.
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect()) or [0]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), F.expr(f"`{slot}` div {page * FAN**k}").alias("_block")) for k in levels]))
    inside = (F.col(slot) >= F.col("lo")) & (F.col(slot) < F.col("hi"))
    probe = lambda df: df.withColumn("_at", at).select(*df.columns, "_at._level", "_at._block")
    if how == "inner":
        return probe(rows).join(covered, [*keys, "_level", "_block"]).filter(inside).drop("_level", "_block")
    if len(levels) == 1:
        named = covered.select(*[F.col(c).alias(f"_r_{c}") if c not in ("lo", "hi") else F.col(c) for c in covered.columns])
        on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_level") == F.col("_r__level"), F.col("_block") == F.col("_r__block"), inside]
        return probe(rows).join(named, on, how).drop("_level", "_block")
    held = probe(rows.select(*keys, slot)).join(covered.select(*keys, "_level", "_block", "lo", "hi"), [*keys, "_level", "_block"]).filter(inside).select(*keys, slot).distinct()
    return rows.join(held, [*keys, slot], how)
