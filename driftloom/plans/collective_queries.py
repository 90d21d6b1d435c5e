"""Queries of the collectives. Ranked table: lineitem by return flag (world), line number (rank), supplier (slot)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collectives as c
from ..operators.ordering import number_rows
from .registry import read, register

RANKED = """r AS (SELECT l_returnflag AS world, l_linenumber - 1 AS rank, l_suppkey AS slot, CAST(sum(l_quantity) AS BIGINT) AS value
             FROM lineitem GROUP BY ALL)"""
WORLD = """w AS (SELECT DISTINCT world, rank FROM r)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("world"), (F.col("l_linenumber") - 1).alias("rank"), F.col("l_suppkey").alias("slot")).agg(
        F.sum("l_quantity").cast("long").alias("value"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings: world = label, rank = vector, slot = position."""
    return read(spark, sf, "embeddings").select(F.col("label").alias("world"), F.col("vec_id").alias("rank"), F.posexplode("embedding").alias("slot", "value"))


VECTORS = """v AS (SELECT label AS world, vec_id AS rank, generate_subscripts(embedding, 1) - 1 AS slot, unnest(embedding) AS value FROM embeddings)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's customers as ranks of a grid of 1 to 4 columns, which does not divide each nation's number."""
    n = number_rows(read(spark, sf, "customer").select(F.col("c_nationkey").alias("world"), "c_custkey"), ["world"], ["c_custkey"], "rank").withColumn("rank", F.col("rank").cast("int"))
    sizes = n.groupBy("world").agg(F.count("*").cast("int").alias("size")).withColumn("d1", (F.col("world") % 4 + 1).cast("int")).withColumn("d0", F.greatest(F.expr("size div d1"), F.lit(1)).cast("int"))
    return n.join(sizes, "world").select("world", "rank", "size", "d0", "d1")


GRID = """g AS (SELECT c_nationkey AS world, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS size, c_nationkey % 4 + 1 AS d1,
  greatest(count(*) OVER (PARTITION BY c_nationkey) // (c_nationkey % 4 + 1), 1) AS d0 FROM customer), xy AS (SELECT *, rank // d1 AS c0, rank % d1 AS c1 FROM g)"""

register("c01_broadcast", lambda s, d: c.broadcast(ranked(s, d), 0), f"WITH {RANKED}, {WORLD} SELECT r.world, w.rank, slot, value FROM r JOIN w ON r.world = w.world WHERE r.rank = 0")
register("c02_scatter", lambda s, d: c.scatter(c.gather(vectors(s, d), 64), 16).withColumn("value", F.col("value").cast("double")),
         f"WITH {VECTORS} SELECT world, (rank * 64 + slot) // 16 AS rank, (rank * 64 + slot) % 16 AS slot, value::DOUBLE AS value FROM v")
register("c03_gather", lambda s, d: c.gather(vectors(s, d), 64).withColumn("value", F.col("value").cast("double")), f"WITH {VECTORS} SELECT world, rank * 64 + slot AS slot, value::DOUBLE AS value FROM v")


def _slots(spark: SparkSession, sf: str) -> int:
    """The buffers' length: one slot more than there are suppliers."""
    return read(spark, sf, "supplier").count() + 1


register("c04_allgather", lambda s, d: c.allgather(ranked(s, d), _slots(s, d)), f"WITH {RANKED}, {WORLD}, k AS (SELECT count(*) + 1 AS n FROM supplier) SELECT r.world, w.rank, r.rank * n + slot AS slot, value FROM r JOIN w ON r.world = w.world, k")
register("c05_reduce", lambda s, d: c.reduce(ranked(s, d), "sum"), f"WITH {RANKED} SELECT world, slot, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY ALL")
register("c06_reduce_max", lambda s, d: c.reduce(ranked(s, d), "max"), f"WITH {RANKED} SELECT world, slot, max(value) AS value FROM r GROUP BY ALL")
register("c07_reduce_min", lambda s, d: c.reduce(ranked(s, d), "min"), f"WITH {RANKED} SELECT world, slot, min(value) AS value FROM r GROUP BY ALL")
register("c08_reduce_sum_decimal", lambda s, d: c.reduce(ranked(s, d).withColumn("value", F.col("value").cast("decimal(20,0)")), "sum").withColumn("value", F.col("value").cast("long")),
         f"WITH {RANKED} SELECT world, slot, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY ALL")
register("c09_allreduce", lambda s, d: c.allreduce(ranked(s, d), "sum"), f"WITH {RANKED} SELECT world, rank, slot, CAST(sum(value) OVER (PARTITION BY world, slot) AS BIGINT) AS value FROM r")
register("c10_scan", lambda s, d: c.scan(ranked(s, d), "sum"), f"WITH {RANKED} SELECT world, rank, slot, CAST(sum(value) OVER (PARTITION BY world, slot ORDER BY rank) AS BIGINT) AS value FROM r")
register("c10_scan_max", lambda s, d: c.scan(ranked(s, d), "max"), f"WITH {RANKED} SELECT world, rank, slot, max(value) OVER (PARTITION BY world, slot ORDER BY rank) AS value FROM r")
register("c11_all_to_all", lambda s, d: c.all_to_all(ranked(s, d), _slots(s, d) // 7 + 1), f"WITH {RANKED}, k AS (SELECT (count(*) + 1) // 7 + 1 AS n FROM supplier) SELECT world, (slot // n)::INT AS rank, rank * n + slot % n AS slot, value FROM r, k")


def _channel_events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    e = read(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.select(F.lit("w").alias("world"), (F.col("user_id") % 7).alias("src"), (F.col("user_id") % 5).alias("dst"), F.col("event_id").alias("ord"), F.floor("value").alias("count"))


register("c12_match_messages", lambda s, d: c.match_messages(_channel_events(s, d, "view"), _channel_events(s, d, "click")), """
WITH e AS (SELECT event_type, 'w' AS world, user_id % 7 AS src, user_id % 5 AS dst, floor(value)::BIGINT AS c,
                  row_number() OVER (PARTITION BY event_type, user_id % 7, user_id % 5 ORDER BY event_id) - 1 AS n FROM events),
s AS (SELECT * FROM e WHERE event_type = 'view'), r AS (SELECT * FROM e WHERE event_type = 'click')
SELECT world, src, dst, n, s.c AS send_count, r.c AS recv_count, CASE WHEN s.c IS NOT NULL AND r.c IS NOT NULL THEN least(s.c, r.c) END AS copied,
       CASE WHEN r.c IS NULL THEN 'unreceived' WHEN s.c IS NULL THEN 'unsent' ELSE 'matched' END AS status
FROM s FULL JOIN r USING (world, src, dst, n)""")
register("c13_ring_shift", lambda s, d: c.ring_shift(ranked(s, d), c.ranks_of(ranked(s, d)).groupBy("world").agg(F.count("*").alias("size"))),
         f"WITH {RANKED}, {WORLD} SELECT r.world, ((rank + 1) % n.size)::INT AS rank, slot, value FROM r JOIN (SELECT world, count(*) AS size FROM w GROUP BY world) n ON r.world = n.world")
register("c14_grid_coords", lambda s, d: c.grid_coords(grid(s, d)).select("world", "rank", "c0", "c1", "c2", "valid"), f"WITH {GRID} SELECT world, rank::INT AS rank, c0::INT AS c0, c1::INT AS c1, 0 AS c2, d0 * d1 = size AS valid FROM xy")
register("c15_grid_rank", lambda s, d: c.grid_rank(c.grid_coords(grid(s, d)).drop("rank")).select("world", "c0", "c1", "rank"), f"WITH {GRID} SELECT world, c0::INT AS c0, c1::INT AS c1, rank::INT AS rank FROM xy")


def c16_grid_shift(s: SparkSession, d: str) -> DataFrame:
    """Neighbours along all three axes, two steps along the second."""
    g = grid(s, d)
    rows = [c.grid_shift(g, axis, by).select("world", "rank", F.lit(axis).alias("axis"), "source", "dest") for axis, by in ((0, 1), (1, 2), (2, 1))]
    return rows[0].union(rows[1]).union(rows[2])


register("c16_grid_shift", c16_grid_shift, f"""
WITH {GRID} SELECT world, rank::INT AS rank, 0 AS axis, ((c0 - 1 + d0) % d0 * d1 + c1)::INT AS source, ((c0 + 1) % d0 * d1 + c1)::INT AS dest FROM xy
UNION ALL SELECT world, rank::INT, 1, (c0 * d1 + (c1 - 2 + 2 * d1) % d1)::INT, (c0 * d1 + (c1 + 2) % d1)::INT FROM xy UNION ALL SELECT world, rank::INT, 2, rank::INT, rank::INT FROM xy""")


def _rank_hosts(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    return s.select(F.lit("w").alias("world"), F.col("s_suppkey").alias("rank"), F.col("s_nationkey").alias("host"))


HOSTS = """h AS (SELECT s_suppkey AS rank, s_nationkey AS host, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS leader,
                 count(*) OVER (PARTITION BY s_nationkey) AS n, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS nh,
                 (SELECT count(*) FROM supplier) AS size, (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) AS home FROM supplier)"""
register("c17_broadcast_counts", lambda s, d: c.exchange_counts(_rank_hosts(s, d), 1, "broadcast"), f"""WITH {HOSTS} SELECT 'w' AS world, rank,
  CASE WHEN rank = 1 OR (rank = leader AND host <> home) THEN n - 1 ELSE 0 END AS local, CASE WHEN rank = 1 THEN nh - 1 ELSE 0 END AS remote FROM h""")
register("c17_reduce_counts", lambda s, d: c.exchange_counts(_rank_hosts(s, d), 1, "reduce"), f"""WITH {HOSTS} SELECT 'w' AS world, rank,
  CASE WHEN rank = 1 THEN 0 WHEN host = home OR rank <> leader THEN 1 ELSE 0 END::BIGINT AS local, CASE WHEN host <> home AND rank = leader THEN 1 ELSE 0 END::BIGINT AS remote FROM h""")
register("c17_gather_counts", lambda s, d: c.exchange_counts(_rank_hosts(s, d), 1, "gather"), f"""WITH {HOSTS} SELECT 'w' AS world, rank,
  CASE WHEN rank = 1 THEN 0 WHEN host = home OR rank <> leader THEN 1 ELSE 0 END::BIGINT AS local, CASE WHEN host <> home AND rank = leader THEN 1 ELSE 0 END::BIGINT AS remote,
  CASE WHEN rank = 1 THEN 0 WHEN host <> home AND rank = leader THEN n ELSE 1 END::BIGINT AS blocks FROM h""")
register("c17_alltoall_counts", lambda s, d: c.exchange_counts(_rank_hosts(s, d), 1, "alltoall"), f"WITH {HOSTS} SELECT 'w' AS world, rank, n - 1 AS local, size - n AS remote FROM h")


def _variable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Buffers of different lengths: world = line status, rank = supplier, as many slots as it has line numbers."""
    li = read(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("world"), F.col("l_suppkey").alias("rank"), (F.col("l_linenumber") - 1).cast("long").alias("slot")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return li, li.groupBy("world", "rank").agg((F.max("slot") + 1).alias("count"))


def _long_variable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """World = line status, rank = line number, a slot up to the rank's last part."""
    li = read(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("world"), (F.col("l_linenumber") - 1).alias("rank"), F.col("l_partkey").alias("slot")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return li, li.groupBy("world", "rank").agg((F.max("slot") + 1).alias("count"))


VARIABLE = """b AS (SELECT l_linestatus AS world, {rank} AS rank, {slot}::BIGINT AS slot, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL),
n AS (SELECT world, rank, max(slot) + 1 AS count FROM b GROUP BY ALL),
o AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY world ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM n)"""
register("c18_gatherv", lambda s, d: c.gatherv(*_variable(s, d)), f"WITH {VARIABLE.format(rank='l_suppkey', slot='l_linenumber - 1')} SELECT b.world, off + slot AS slot, value FROM b JOIN o USING (world, rank)")
register("c18_allgatherv", lambda s, d: c.allgatherv(*_long_variable(s, d)), f"WITH {VARIABLE.format(rank='l_linenumber - 1', slot='l_partkey')} SELECT b.world, n.rank, off + slot AS slot, value FROM b JOIN o USING (world, rank) JOIN n ON n.world = b.world")
def _scattered(s: SparkSession, d: str, covered: bool) -> tuple[DataFrame, DataFrame]:
    """Counts that cover all slots, the more the higher the rank, or about a third of them."""
    return c.reduce_scatter(ranked(s, d), c.ranks_of(ranked(s, d)).withColumn("count", (F.col("rank") + (_slots(s, d) // 7 + 1 if covered else 2)).cast("long")))


SCATTERED = f"""{RANKED}, {WORLD}, k AS (SELECT (count(*) + 1) // 7 + 1 AS n FROM supplier), t AS (SELECT world, slot, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY ALL)"""
register("c19_reduce_scatter", lambda s, d: _scattered(s, d, True)[0], f"""
WITH {SCATTERED}, o AS (SELECT world, rank, rank + n AS n, coalesce(sum(rank + n) OVER (PARTITION BY world ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM w, k)
SELECT t.world, o.rank, slot - off AS slot, value FROM t JOIN o ON t.world = o.world AND slot >= off AND slot < off + n""")
register("c19_scatter_rejects", lambda s, d: _scattered(s, d, False)[1], f"WITH {SCATTERED}, o AS (SELECT world, sum(rank + 2) AS n FROM w GROUP BY world) SELECT t.world, slot, value FROM t JOIN o ON t.world = o.world AND slot >= n")


def _exchanged(s: SparkSession, d: str, covered: bool) -> tuple[DataFrame, DataFrame]:
    """Rank i sends i + j + 1 slots to rank j, and a seventh of all if the counts are to cover the buffers."""
    r = ranked(s, d)
    w, more = c.ranks_of(r), _slots(s, d) // 7 + 1 if covered else 1
    counts = w.select("world", F.col("rank").alias("src")).join(w.select("world", F.col("rank").alias("dst")), "world")
    return c.all_to_allv(r, counts.withColumn("count", (F.col("src") + F.col("dst") + more).cast("long")))


EXCHANGED = f"""{RANKED}, {WORLD}, m AS (SELECT (count(*) + 1) // 7 + 1 AS more FROM supplier)"""
register("c20_all_to_allv", lambda s, d: _exchanged(s, d, True)[0], f"""
WITH {EXCHANGED}, k AS (SELECT a.world, a.rank AS src, b.rank AS dst, a.rank + b.rank + more AS n FROM w a JOIN w b ON a.world = b.world, m),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY world, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so,
             coalesce(sum(n) OVER (PARTITION BY world, dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ro FROM k)
SELECT r.world, dst AS rank, (ro + slot - so)::BIGINT AS slot, value FROM r JOIN o ON r.world = o.world AND r.rank = o.src AND slot >= so AND slot < so + n""")
register("c20_exchange_rejects", lambda s, d: _exchanged(s, d, False)[1], f"""
WITH {EXCHANGED}, o AS (SELECT a.world, a.rank, sum(a.rank + b.rank + 1) AS n FROM w a JOIN w b ON a.world = b.world GROUP BY ALL) SELECT r.world, r.rank, slot, value FROM r JOIN o ON r.world = o.world AND r.rank = o.rank AND slot >= n""")
register("c21_reduce_logic", lambda s, d: c.reduce(ranked(s, d).withColumn("value", F.col("value") > 20), "land").withColumnRenamed("value", "every").join(
    c.reduce(ranked(s, d).withColumn("value", F.col("value") > 60), "lor").withColumnRenamed("value", "some"), ["world", "slot"]),
    f"WITH {RANKED} SELECT world, slot, bool_and(value > 20) AS every, bool_or(value > 60) AS some FROM r GROUP BY ALL")
register("c21_reduce_bits", lambda s, d: c.reduce(ranked(s, d), "band").withColumnRenamed("value", "band").join(c.reduce(ranked(s, d), "bor").withColumnRenamed("value", "bor"), ["world", "slot"]),
         f"WITH {RANKED} SELECT world, slot, bit_and(value) AS band, bit_or(value) AS bor FROM r GROUP BY ALL")
register("c21_reduce_prod", lambda s, d: c.reduce(ranked(s, d).withColumn("value", F.col("value") % 3 + 1), "prod"), f"WITH {RANKED} SELECT world, slot, CAST(product(value % 3 + 1) AS BIGINT) AS value FROM r GROUP BY ALL")
register("c21_reduce_long_prod", lambda s, d: c.reduce(ranked(s, d).withColumn("value", (F.col("value") % 300 + 2) * F.when(F.col("rank") == 3, -1).otherwise(1)), "prod"), f"""
WITH {RANKED} SELECT world, slot, list_reduce(list(((value % 300 + 2) * CASE WHEN rank = 3 THEN -1 ELSE 1 END)::HUGEINT), lambda a, x: a * x)::BIGINT AS value FROM r GROUP BY ALL""")


def _unsigned(s: SparkSession, d: str) -> DataFrame:
    """Values with bit 63 set, and lower bits by their size."""
    return ranked(s, d).withColumn("value", (F.col("value").cast("decimal(20,0)") * 4_000_000_007 + F.lit(Decimal(1 << 63))).cast("decimal(20,0)"))


register("c21_reduce_unsigned", lambda s, d: c.reduce(_unsigned(s, d), "band").withColumnRenamed("value", "band").join(c.reduce(_unsigned(s, d), "bor").withColumnRenamed("value", "bor"), ["world", "slot"]).select(
    "world", "slot", F.col("band").cast("string").alias("band"), F.col("bor").cast("string").alias("bor")),
    f"WITH {RANKED}, u AS (SELECT *, (value::HUGEINT * 4000000007 + 9223372036854775808)::UBIGINT AS v FROM r) SELECT world, slot, bit_and(v)::VARCHAR AS band, bit_or(v)::VARCHAR AS bor FROM u GROUP BY ALL")
register("c22_maxloc", lambda s, d: c.reduce(ranked(s, d), "maxloc"), f"WITH {RANKED} SELECT world, slot, max(value) AS value, arg_min(rank, (-value, rank)) AS loc FROM r GROUP BY ALL")
register("c22_minloc", lambda s, d: c.reduce(ranked(s, d), "minloc"), f"WITH {RANKED} SELECT world, slot, min(value) AS value, arg_min(rank, (value, rank)) AS loc FROM r GROUP BY ALL")
register("c23_split", lambda s, d: c.split_world(read(s, d, "customer").select(F.col("c_mktsegment").alias("world"), F.col("c_custkey").alias("rank"), F.col("c_nationkey").alias("color"), F.col("c_acctbal").alias("key"))).select("world", "rank", "color", "new_rank"),
         "SELECT c_mktsegment AS world, c_custkey AS rank, c_nationkey AS color, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal, c_custkey)::INT - 1 AS new_rank FROM customer")


def _horner(so_far: float, value: int) -> float:
    """Not commutative: 3 * (3 * a + b) + c ..."""
    return 3 * so_far + value


register("c24_user_reduction", lambda s, d: c.reduce_with(ranked(s, d), _horner, 0.0),
         f"WITH {RANKED} SELECT world, slot, CAST(sum(value * pow(3, k - i)) AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY world, slot ORDER BY rank) AS i, count(*) OVER (PARTITION BY world, slot) AS k FROM r) GROUP BY ALL")


def _longest(a: list, b: list) -> list:
    """Associative, not commutative: joins runs (first, last, length of the longest rise, of the first, of the last, size)."""
    rise = b[0] >= a[1]
    return [a[0], b[1], max(a[2], b[2], a[4] + b[3] if rise else 0), a[3] + b[3] if rise and a[3] == a[5] else a[3], a[4] + b[4] if rise and b[4] == b[5] else b[4], a[5] + b[5]]


def c24_partial_combine(s: SparkSession, d: str) -> DataFrame:
    """The longest rise of each slot's values over the ranks."""
    one = F.lit(1).cast("long")
    runs = c.combine_with(ranked(s, d).withColumn("value", F.array("value", "value", one, one, one, one)), _longest, "array<bigint>", commute=False)
    return runs.select("world", "slot", F.col("value")[2].alias("rise"))


register("c24_partial_combine", c24_partial_combine, f"""
WITH {RANKED}, f AS (SELECT *, CASE WHEN value >= lag(value) OVER (PARTITION BY world, slot ORDER BY rank) THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY world, slot ORDER BY rank) AS g FROM f), h AS (SELECT world, slot, g, count(*) AS n FROM g GROUP BY ALL) SELECT world, slot, max(n) AS rise FROM h GROUP BY ALL""")
