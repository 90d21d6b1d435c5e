"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are masks over those bits, so a new policy or an ablation of an old one reads the ledger and never
the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

#: Rules by bit: name and condition of failure over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
]
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that each of them applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": tuple(name for name, _ in RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _twin_positions(ordered: Column) -> Column:
    """Positions of the windows that occur twice or more, ascending. `ordered`: (hash, position) pairs in order."""
    twins = F.filter(
        ordered,
        lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | (F.get(ordered, i + 1)["h"] == x["h"]),
    )
    return F.sort_array(F.transform(twins, lambda x: x["p"]))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts have measurements of 0; repeated rows are measured alike; an empty table gives an empty result.
    Windows are compared by a 64-bit hash of their words. Columns of docs with the names of the measurements, or of the
    steps to them (_words, _lines, _hashes, _windows, _sorted, _starts), are replaced: `keep_documents` guards its input."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({
        "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size("_words")
    # Each word is hashed once, each window as the hash of three of these.
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_windows",
        F.transform(F.slice("_hashes", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))),
    )
    # Most documents repeat no window: only the others are sorted.
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    df = df.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), _twin_positions(F.col("_sorted"))))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    lines = F.size("_lines")
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": lines.cast("long"),
        "n_dup_lines": (lines - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements and `fail_bits` (bit i: rule i of RULES failed). Other columns are left out, so
    their names do no harm; nulls, repeats and empty tables are as in `measure`."""
    return _with_bits(measure(docs.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col))


def keep_documents(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with all their columns. The measurements never meet the columns of
    docs, so equal names do no harm. A null, empty or blank text has no words and fails any policy with few_words;
    repeated rows pass or fail alike; an empty table gives an empty result."""
    held = _with_bits(measure(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))))
    # The partition number keeps the optimizer from moving the filter below the measurements, where it would
    # repeat them for every use.
    held = held.select("doc", "fail_bits", F.spark_partition_id().alias("part"))
    return held.filter(passes(policy) & (F.col("part") >= 0)).select("doc.*")


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. Reads bits only."""
    all_bits = mask(POLICIES[policy])
    sums = book.agg(*[
        x for r in POLICIES[policy] for x in (
            F.coalesce(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(mask((r,)))) != 0, 1)), F.lit(0)).alias(f"{r}_fails"),
            F.coalesce(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(all_bits)) == mask((r,)), 1)), F.lit(0)).alias(f"{r}_alone"),
        )
    ])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_fails").cast("long").alias("fails"), F.col(f"{r}_alone").cast("long").alias("alone")) for r in POLICIES[policy]])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def op10_quality_ledger(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text has no words and fails the base rules."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-1")).alias("base_failed"), passes("strict-1").alias("kept"), "fail_bits",
    )


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, p, struct_pack(a := ws[p], b := ws[p + 1], c := ws[p + 2]) AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (2 * n_symbols > n_words)::BIGINT + 8 * (word_chars > 25 * n_words)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
