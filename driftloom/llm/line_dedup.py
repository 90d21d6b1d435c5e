"""Cross-site boilerplate removal by distinct-site spread.

A line that stands on many distinct sites is boilerplate, however often a single site repeats it. Each line
hash gets a HyperLogLog sketch of its sites, merged by aggregation; a line whose estimate is clear of the
threshold is decided by it, a line near the threshold by its exact number of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, line hash h) of the lines that have a word, without surrounding blanks."""
    exploded = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return exploded.filter(F.col("line").rlike(WORD)).select(*keep, "pos", F.xxhash64(F.trim(F.col("line"), F.lit(" \t\r\x0b\f"))).alias("h"))


def _dealt(lines: DataFrame) -> DataFrame:
    """The lines dealt by (h, salt), so that a line with any share of all rows is first summed in many tasks."""
    return lines.withColumn("salt", F.monotonically_increasing_id() % 64).repartition("h", "salt")


def boilerplate_lines(docs: DataFrame, min_sites: int, lg_k: int = 12, band: float = 0.1) -> DataFrame:
    """Hashes `h` of the lines on at least min_sites distinct sites. docs: text, site."""
    # A line on min_sites sites occurs that often: this count leaves out the many lines that occur once.
    often = cut(_lines(docs).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h"), "line-often")
    sketches = _dealt(_lines(docs, "site").join(often, "h", "left_semi")).groupBy("h", "salt").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    merged = sketches.groupBy("h").agg(F.hll_union_agg("sketch").alias("sketch"))
    spread = cut(merged.select("h", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    near = cut(spread.filter(F.col("sites").between(low, high)).select("h"), "line-near")
    exact = _dealt(_lines(docs, "site").join(near, "h", "left_semi")).groupBy("h", "site").agg(F.lit(1).alias("one")).filter("site is not null")
    exact = exact.groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("h")
    return spread.filter(F.col("sites") > high).select("h").union(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per row of docs: id_col, kept_text, n_lines (lines with a word), n_removed.

    Lines end at a line feed and are compared without blanks at their ends; lines without a word always stay.
    Null text counts as empty; a null site is no site; repeated rows are each cleaned alike; an empty table
    gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).cast("string").alias("site"))
    found = cut(boilerplate_lines(docs, min_sites), "line-boilerplate")
    # A text is known by its id and hash, so only texts of one id could be taken for each other.
    docs = docs.withColumn("t", F.xxhash64("text"))
    hit = _lines(docs, "id", "t").join(found, "h").groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("gone"))
    parts = F.split("text", "\n")
    rows = docs.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("id", parts.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    flags = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    return rows.select(
        F.col("id").alias(id_col), F.array_join(flags, "\n").alias("kept_text"),
        F.size(F.filter("lines", lambda x: x.rlike(WORD))).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
    )


def op5_site_spread_lines(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text has no lines."""
    return remove_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
l AS (SELECT r, doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
b AS (SELECT bare FROM k WHERE word GROUP BY bare HAVING count(DISTINCT source) >= 10),
m AS (SELECT *, word AND bare IN (SELECT bare FROM b) AS gone FROM k),
o AS (SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r, doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM o
"""
