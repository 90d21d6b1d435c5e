"""Exact deduplication by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes of the text. Each level splits every open group by its next digit;
groups of one row leave at once, groups whose texts have ended are groups of equal texts. Digits grow
geometrically, so the number of levels is the logarithm of the longest text that has a twin, and each byte
is compared at most once a level. Equality is decided by the bytes themselves, never by a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def radix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = 64, growth: int = 8) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 and the digest-free row number `row`.

    Of equal texts the row with the largest id stays; between repeated rows of one id, one of them.
    Null text counts as empty, so all null and empty texts form one group. A null id ranks below all ids.
    An empty table gives an empty result. Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.octet_length("text").alias("n"), F.substring(F.col("text").cast("binary"), 1, first_digit).alias("head")
    )
    # Level 1: the length and the first bytes. Groups of one leave without their text. Counts of groups are cut
    # into tables, so that each join has a plain exchange on either side, which AQE splits where a group is hot.
    heads = cut(base.groupBy("n", "head").agg(F.count("*").alias("c")).filter("c > 1"), "radix-heads")
    rows = cut(
        base.join(heads, ["n", "head"], "left").select(
            F.monotonically_increasing_id().alias("row"), "id", F.sha2("text", 256).alias("text_sha256"),
            F.when(F.col("c") > 1, F.concat_ws(":", "n", F.hex("head"))).alias("g"),
            F.when(F.col("c") > 1, F.expr(f"substring(cast(text as binary), {first_digit + 1})")).alias("rest"),
        ),
        "radix-1",
    )
    open_rows, ended, width = rows.filter("g is not null").select("row", "id", "g", "rest"), [], first_digit
    while True:
        width *= growth
        level = open_rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        groups = cut(level.groupBy("g", "digit").agg(F.count("*").alias("c"), F.min("row").alias("gid")).filter("c > 1").drop("c"), "radix-groups")
        level = cut(
            level.join(groups, ["g", "digit"]).select(
                "row", "id", F.col("gid").cast("string").alias("g"), F.expr(f"substring(rest, {width + 1})").alias("rest"),
                (F.length("rest") <= width).alias("done"),
            ),
            "radix",
        )
        ended.append(level.filter("done").select("row", "id", "g"))
        open_rows = level.filter("not done").drop("done")
        if open_rows.isEmpty():
            break
    members = reduce(DataFrame.union, ended)
    best = cut(members.groupBy("g").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("size")), "radix-best")
    found = members.join(best, "g").select("row", "best", "size")
    single = F.col("size").isNull()
    return rows.select("row", "id", "text_sha256").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256", "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that radix_dedup keeps, with all their columns: one row of each group of equal texts. Null and
    empty texts are one group; of rows that repeat id and text one stays; a null id stays only where its group has no
    other. An empty table gives an empty result."""
    kept = radix_dedup(docs, id_col, text_col).groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_times")).filter("_kept").drop("_kept")
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    rows = held.join(cut(kept, "kept"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    # Rows that repeat both id and text are rare: only they are compared once more.
    once = rows.filter("_times = 1").union(rows.filter("_times > 1").dropDuplicates(["id", "sha"]))
    return once.select("doc.*")


def op8_radix_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text is an empty one, of rows with equal texts and ids one stays."""
    from .common import table

    return radix_dedup(table(spark, sf_dir, "documents")).drop("row")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
