"""Queries of diff and merge. Base: part by brand, slot = part key, value = size modulo 50, so that some are zero; versions
by rules on the key."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffmerge as m
from .registry import read, register

BASE = "b AS (SELECT p_brand AS dataset, p_partkey AS slot, p_size::BIGINT % 50 AS value FROM part)"
NEW = "n AS (SELECT p_brand AS dataset, p_partkey AS slot, p_size % 50 + CASE WHEN p_partkey % 97 < 60 THEN p_partkey % 4 ELSE 0 END AS value FROM part)"
WORKERS = """w AS (SELECT p_brand AS dataset, k AS worker, p_partkey AS slot, p_size % 50 + CASE WHEN p_partkey % 5 = k THEN p_partkey % 7 + k ELSE 0 END AS value FROM part, range(3) t(k))"""


def base(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("slot"), (F.col("p_size").cast("long") % 50).alias("value"))


def new(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).withColumn("value", F.col("value") + F.when(F.col("slot") % 97 < 60, F.col("slot") % 4).otherwise(0))


def workers(s: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    return base(s, d).select("dataset", k.alias("worker"), "slot", "value").withColumn(
        "value", F.col("value") + F.when(F.col("slot") % 5 == F.col("worker"), F.col("slot") % 7 + F.col("worker")).otherwise(0))


def flat(df: DataFrame) -> DataFrame:
    """All brands as one dataset, so that slots are dense."""
    return df.withColumn("dataset", F.lit("all"))


register("d01_changed_runs", lambda s, d: m.changed_runs(flat(base(s, d)), flat(new(s, d))), f"""
WITH {BASE}, {NEW}, c AS (SELECT slot FROM b JOIN n USING (slot) WHERE b.value <> n.value),
i AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS g FROM c)
SELECT 'all' AS dataset, min(slot) AS "offset", count(*) AS length FROM i GROUP BY g""")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    ops = F.element_at(F.array(*[F.lit(x) for x in ("sum", "subtract", "product", "max", "min", "xor", "overwrite")]), (F.col("slot") % 7 + 1).cast("int"))
    return base(s, d).withColumnRenamed("value", "old").join(new(s, d).withColumnRenamed("value", "new"), m.CELL).withColumn("op", ops)


PAIRS = f"""{BASE}, {NEW}, p AS (SELECT b.dataset, slot, b.value AS old, n.value AS new, ['sum', 'subtract', 'product', 'max', 'min', 'xor', 'overwrite'][slot % 7 + 1] AS op FROM b JOIN n USING (dataset, slot))"""
DELTA = """CASE op WHEN 'sum' THEN new - old WHEN 'subtract' THEN old - new WHEN 'product' THEN CASE WHEN old <> 0 THEN new // old END WHEN 'xor' THEN xor(old, new) ELSE new END"""
register("d02_typed_diff", lambda s, d: m.typed_diff(_pairs(s, d)), f"WITH {PAIRS} SELECT dataset, slot, op, {DELTA} AS delta FROM p WHERE old <> new")
register("d03_apply_diff", lambda s, d: m.apply_diffs(base(s, d), m.typed_diff(_pairs(s, d))), f"""
WITH {PAIRS} SELECT dataset, slot, CASE WHEN old = new OR (op = 'product' AND old = 0) THEN old WHEN op = 'product' THEN old * (new // old) WHEN op = 'max' THEN greatest(old, new) WHEN op = 'min' THEN least(old, new) ELSE new END AS value FROM p""")


def _queued(s: SparkSession, d: str, op: str) -> DataFrame:
    """Line items as queued diffs to parts: worker = line number, seq = order."""
    li = read(s, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("dataset"), F.col("l_partkey").alias("slot"), F.lit(op).alias("op"), F.col("l_quantity").cast("long").alias("delta"),
                     F.col("l_linenumber").alias("worker"), F.struct("l_orderkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_shipdate").alias("seq"))


QUEUE = "q AS (SELECT l_returnflag AS dataset, l_partkey AS slot, l_quantity::BIGINT AS delta, l_linenumber AS worker, (l_orderkey, l_suppkey, l_extendedprice, l_tax, l_discount, l_shipdate) AS seq FROM lineitem)"
register("d04_overwrite_merge", lambda s, d: m.merge_overwrite(base(s, d).withColumn("dataset", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))), _queued(s, d, "overwrite").withColumnRenamed("delta", "value")), f"""
WITH {BASE}, {QUEUE}, l AS (SELECT dataset, slot, arg_max(delta, (worker, seq)) AS v FROM q GROUP BY dataset, slot), c AS (SELECT t.dataset, slot, value FROM b, (VALUES ('A'), ('N'), ('R')) t(dataset))
SELECT dataset, slot, coalesce(l.v, c.value) AS value FROM c FULL JOIN l USING (dataset, slot)""")
register("d05_xor_merge", lambda s, d: m.xor_merge(base(s, d), workers(s, d)), f"""
WITH {BASE}, {WORKERS} SELECT b.dataset, slot, xor(b.value, bit_xor(xor(b.value, w.value))) AS value FROM b JOIN w USING (dataset, slot) GROUP BY b.dataset, slot, b.value""")


def _unsigned(df: DataFrame) -> DataFrame:
    return df.withColumn("value", (F.col("value").cast("decimal(20,0)") * 1_000_003 + F.lit(Decimal(1 << 63))).cast("decimal(20,0)"))


register("d05_xor_unsigned", lambda s, d: m.xor_merge(_unsigned(base(s, d)), _unsigned(workers(s, d))).withColumn("value", F.col("value").cast("string")), f"""
WITH {BASE}, {WORKERS}, x AS (SELECT b.dataset, slot, (b.value::HUGEINT * 1000003 + 9223372036854775808)::UBIGINT AS b, (w.value::HUGEINT * 1000003 + 9223372036854775808)::UBIGINT AS w FROM b JOIN w USING (dataset, slot))
SELECT dataset, slot, xor(b, bit_xor(xor(b, w)))::VARCHAR AS value FROM x GROUP BY dataset, slot, b""")


def _regions(s: SparkSession, d: str) -> DataFrame:
    """Per brand: [0, 50) summed, [100, 200) ignored, [300, 400) max."""
    r = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("len"), F.lit(o).alias("op")) for a, b, o in ((0, 50, "sum"), (100, 100, "ignore"), (300, 100, "max"))]))
    return base(s, d).select("dataset").distinct().select("dataset", r.alias("r")).select("dataset", "r.*")


OP_OF = "CASE WHEN slot < 50 THEN 'sum' WHEN slot >= 100 AND slot < 200 THEN 'ignore' WHEN slot >= 300 AND slot < 400 THEN 'max' ELSE 'overwrite' END"
register("d06_ignore_regions", lambda s, d: m.drop_ignored(m.typed_diff(_pairs(s, d)), _regions(s, d), m.sizes_of(base(s, d))),
         f"WITH {PAIRS} SELECT dataset, slot, op, {DELTA} AS delta FROM p WHERE old <> new AND NOT (slot >= 100 AND slot < 200)")
register("d07_fill_gaps", lambda s, d: m.fill_gaps(_regions(s, d), m.sizes_of(base(s, d))), f"""
WITH {BASE}, z AS (SELECT dataset, max(slot) + 1 AS size FROM b GROUP BY dataset)
SELECT dataset, lo::BIGINT AS lo, len::BIGINT AS len, op FROM z, (VALUES (0, 50, 'sum'), (100, 100, 'ignore'), (300, 100, 'max'), (50, 50, 'overwrite'), (200, 100, 'overwrite'), (400, 0, 'overwrite')) v(lo, len, op)
WHERE lo < 400 OR size > 400""")


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """Each dataset's pages by flags of two workers; nobody has written the second page."""
    pages = m.mark_pages(base(s, d).withColumn("worker", F.col("slot") % 2))
    return m.merge_page_flags(pages.withColumn("dirty", F.col("page") != 1)).filter("dirty").select("dataset", "page")


register("d08_region_diff", lambda s, d: m.diff_regions(base(s, d), new(s, d), m.fill_gaps(_regions(s, d), m.sizes_of(base(s, d))), _dirty(s, d)).drop("region"), f"""
WITH {PAIRS}, r AS (SELECT dataset, slot, old, new, {OP_OF} AS op FROM p)
SELECT dataset, slot, op, {DELTA} AS delta FROM r WHERE old <> new AND op <> 'ignore' AND slot // 4096 <> 1""")
register("d09_fold_diffs", lambda s, d: m.fold_diffs(_queued(s, d, "sum").unionByName(_queued(s, d, "max").withColumn("dataset", F.concat("dataset", F.lit("m")))).unionByName(_queued(s, d, "overwrite").withColumn("dataset", F.concat("dataset", F.lit("o")))))[0], f"""
WITH {QUEUE} SELECT dataset, slot, 'sum' AS op, sum(delta)::BIGINT AS delta, count(*) AS n_diffs FROM q GROUP BY dataset, slot
UNION ALL SELECT dataset || 'm', slot, 'max', max(delta), count(*) FROM q GROUP BY dataset, slot
UNION ALL SELECT dataset || 'o', slot, 'overwrite', arg_max(delta, (worker, seq)), count(*) FROM q GROUP BY dataset, slot""")
register("d09_fold_products", lambda s, d: m.fold_diffs(_queued(s, d, "product").withColumn("delta", F.col("delta") % 7 * F.when(F.col("worker") % 2 == 0, -1).otherwise(1)))[0], f"""
WITH {QUEUE}, v AS (SELECT dataset, slot, delta % 7 * CASE WHEN worker % 2 = 0 THEN -1 ELSE 1 END AS x FROM q)
SELECT dataset, slot, 'product' AS op, list_reduce(list(x::HUGEINT), lambda a, y: a * y)::BIGINT AS delta, count(*) AS n_diffs FROM v GROUP BY dataset, slot""")
register("d10_fork_join", lambda s, d: m.fork_join(base(s, d), workers(s, d), _regions(s, d))[0], f"""
WITH {BASE}, {WORKERS}, x AS (SELECT b.dataset, slot, b.value AS old, w.value AS new, worker, {OP_OF} AS op FROM b JOIN w USING (dataset, slot))
SELECT dataset, slot, CASE op WHEN 'sum' THEN old + sum(new - old) WHEN 'ignore' THEN old WHEN 'max' THEN greatest(old, max(new) FILTER (WHERE new <> old))
  ELSE coalesce(arg_max(new, worker) FILTER (WHERE new <> old), old) END::BIGINT AS value FROM x GROUP BY dataset, slot, old, op""")
register("d11_change_log", lambda s, d: m.change_log(
    read(s, d, "events").select(F.col("user_id").alias("dataset"), F.col("event_id").alias("version"), F.floor("value").alias("lo"), F.lit(3).cast("long").alias("len")),
    read(s, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("dataset"), F.col("event_id").alias("version"))), """
WITH v AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'error' GROUP BY 1),
c AS (SELECT DISTINCT e.user_id AS dataset, unnest(range(floor(value)::BIGINT, floor(value)::BIGINT + 3)) AS slot FROM events e LEFT JOIN v USING (user_id) WHERE v IS NULL OR event_id > v),
i AS (SELECT *, slot - row_number() OVER (PARTITION BY dataset ORDER BY slot) AS g FROM c)
SELECT dataset, min(slot) AS "offset", count(*) AS length FROM i GROUP BY dataset, g""")


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    """Per brand: every slot from 0 summed, from 20 on also max, from 40 on also product."""
    r = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(0).cast("long").alias("len"), F.lit(o).alias("op")) for a, o in ((0, "sum"), (20, "max"), (40, "product"))]))
    return base(s, d).select("dataset").distinct().select("dataset", r.alias("r")).select("dataset", "r.*")


# One worker's three diffs of a slot, then those of the next: each step takes the value so far.
OVERLAPS = f"""{BASE}, {WORKERS}, x AS (SELECT b.dataset, slot, b.value AS old, list(w.value ORDER BY worker) FILTER (WHERE w.value <> b.value) AS news FROM b JOIN w USING (dataset, slot) GROUP BY b.dataset, slot, b.value)"""
STEP = """(lambda a, n: CASE WHEN slot < 20 THEN a + n - old WHEN slot < 40 OR old = 0 THEN greatest(a + n - old, n) ELSE greatest(a + n - old, n) * (n // CASE old WHEN 0 THEN 1 ELSE old END) END)"""
register("d10_overlaps", lambda s, d: m.fork_join(base(s, d), workers(s, d), _overlaps(s, d))[0], f"WITH {OVERLAPS} SELECT dataset, slot, CASE WHEN news IS NULL THEN old ELSE list_reduce(list_prepend(old, news), {STEP[1:-1]}) END::BIGINT AS value FROM x")
register("d10_rejects", lambda s, d: m.fork_join(base(s, d), workers(s, d), _overlaps(s, d))[1], f"WITH {BASE}, {WORKERS} SELECT dataset, slot, worker::INT AS worker FROM b JOIN w USING (dataset, slot) WHERE b.value = 0 AND w.value <> 0 AND slot >= 40")
register("d12_dirty_pages", lambda s, d: m.merge_page_flags(read(s, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("worker"), F.expr("event_id div 64").alias("page"), (F.col("value") > 100).alias("dirty"))),
         "SELECT event_type AS dataset, event_id // 64 AS page, bool_or(value > 100) AS dirty FROM events GROUP BY ALL")
register("d13_page_align", lambda s, d: m.page_align(read(s, d, "documents").select("doc_id", (F.col("doc_id") * 1000).alias("offset"), F.col("n_chars").alias("length"))), """
SELECT doc_id, doc_id * 1000 AS "offset", n_chars AS length, (n_chars + 4095) // 4096 AS pages_up, n_chars // 4096 AS pages_down, (doc_id * 1000) // 4096 * 4096 AS aligned_offset,
       (doc_id * 1000) % 4096 AS remainder, (n_chars + (doc_id * 1000) % 4096 + 4095) // 4096 * 4096 AS aligned_length FROM documents""")


def _pages(s: SparkSession, d: str, text) -> DataFrame:
    docs = read(s, d, "documents").select(F.col("doc_id").alias("dataset"), F.coalesce(text, F.lit("")).cast("binary").alias("b")).filter("length(b) > 0")
    pages = docs.select("dataset", "b", F.explode(F.expr(f"sequence(0L, (length(b) - 1) div {m.PAGE})")).alias("page"))
    return pages.select("dataset", "page", F.expr(f"substring(b, cast(page * {m.PAGE} + 1 as int), {m.PAGE})").alias("bytes"))


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace(F.col("text"), F.lit("a"), F.lit("b")), F.lit("more"))).otherwise(F.col("text"))
    return _pages(s, d, F.col("text")), _pages(s, d, changed)


def _told(pages: DataFrame) -> DataFrame:
    return pages.withColumn("bytes", F.md5(F.hex("bytes")))


DOC_PAGES = """t AS (SELECT doc_id AS dataset, hex(encode(coalesce(text, ''))) AS a, hex(encode(coalesce(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'a', 'b') || 'more' ELSE text END, ''))) AS b FROM documents),
o AS (SELECT dataset, page, substr(a, page * 8192 + 1, 8192) AS x FROM (SELECT dataset, a, unnest(range((length(a) + 8191) // 8192)) AS page FROM t)),
n AS (SELECT dataset, page, substr(b, page * 8192 + 1, 8192) AS x FROM (SELECT dataset, b, unnest(range((length(b) + 8191) // 8192)) AS page FROM t))"""
DELTA_ROWS = "o.x IS NULL OR length(o.x) < 8192 OR length(n.x) < 8192 OR o.x <> n.x"
register("d14_paged_delta", lambda s, d: _told(m.paged_delta(*_old_new(s, d), xor=False)), f"""
WITH {DOC_PAGES} SELECT dataset, page, 'OVERWRITE' AS kind, md5(n.x) AS bytes, NULL::BIGINT AS size FROM n LEFT JOIN o USING (dataset, page) WHERE {DELTA_ROWS}
UNION ALL SELECT dataset, NULL, 'SIZE', NULL, length(b) // 2 FROM t WHERE length(b) > 0""")
register("d14_paged_delta_xor", lambda s, d: _told(m.paged_delta(*_old_new(s, d))), f"""
WITH {DOC_PAGES} SELECT dataset, page, CASE WHEN length(o.x) = 8192 AND length(n.x) = 8192 THEN 'XOR' ELSE 'OVERWRITE' END AS kind,
  md5(CASE WHEN length(o.x) = 8192 AND length(n.x) = 8192 THEN hex(xor(unhex(o.x)::BIT, unhex(n.x)::BIT)::BLOB) ELSE n.x END) AS bytes, NULL::BIGINT AS size FROM n LEFT JOIN o USING (dataset, page) WHERE {DELTA_ROWS}
UNION ALL SELECT dataset, NULL, 'SIZE', NULL, length(b) // 2 FROM t WHERE length(b) > 0""")
register("d15_apply_paged_delta", lambda s, d: _told(m.apply_paged_delta(_old_new(s, d)[0], m.paged_delta(*_old_new(s, d)))), f"WITH {DOC_PAGES} SELECT dataset, page, md5(x) AS bytes FROM n")


def _versions(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).withColumn("version", F.lit(1)).unionByName(new(s, d).withColumn("version", F.lit(2)))


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).groupBy("dataset").agg(F.min("slot").alias("k")).select("dataset", (F.col("k") % 2 + 1).cast("int").alias("version"), F.when(F.col("k") % 3 == 0, 1).otherwise(1 << 40).alias("max_size"))


SNAPSHOT = "z AS (SELECT dataset, min(slot) % 2 + 1 AS version, CASE WHEN min(slot) % 3 = 0 THEN 1 ELSE 1099511627776 END AS max_size, max(slot) + 1 AS size FROM b GROUP BY dataset)"
register("d16_restore", lambda s, d: m.restore(_versions(s, d), _snapshots(s, d))[0], f"""
WITH {BASE}, {NEW}, {SNAPSHOT} SELECT dataset, slot, CASE WHEN version = 1 THEN b.value ELSE n.value END AS value FROM b JOIN n USING (dataset, slot) JOIN z USING (dataset) WHERE size <= max_size""")
register("d16_restore_rejects", lambda s, d: m.restore(_versions(s, d), _snapshots(s, d))[1].select("dataset", "size"), f"WITH {BASE}, {SNAPSHOT} SELECT dataset, size FROM z WHERE size > max_size")
