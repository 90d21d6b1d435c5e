"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a schedule of equal-token blocks. Slot i of the schedule has the golden-ratio point frac(i * phi), here an
exact integer modulo 2**60; the source whose interval of cumulative targets holds the point gets the slot, and the k-th
slot of a source takes the k-th block of its stream: its documents in shuffled (hashed) order, as often repeated as
`max_repeat` allows. Any run of slots holds each source near its share; the points leave each source a few blocks off
its target, which its last block settles: it ends where the target is met, so it may be shorter or longer than the
others. A source that no point falls to has its one block in a slot of its own behind the others. Blocks grow with the
corpus up to a largest size, from which on the number of slots grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, n_words, running_start, table

RING_BITS = 60
#: 2**60 divided by the golden ratio, made odd: multiplication by it modulo 2**60 visits every point once.
GOLDEN = 712544676207699905
CELL_BITS, CHUNK_BITS, BUCKET_BITS = 48, 12, 20


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Per source (source, source_size): its rank by code point (null last), weight and target.

    Targets are proportional to the weights and sum to `share` of all sizes; none is above `max_repeat` times
    its source's size, and the excess is shared anew by weight. In ascending order of cap per weight the
    capped sources come first, so one pass of running sums finds the level of the others. The table has one
    row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    df = sources.withColumn("rank", F.row_number().over(by_name))
    df = df.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")),
        "cap": F.col("source_size") * F.lit(float(max_repeat)),
        "want": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    df = df.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    df = df.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return df.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level"))).select("source", "source_size", "rank", "weight", "target")


def in_blocks(goals: DataFrame, slots: int, largest: int) -> DataFrame:
    """Adds to the targets: goal (the target in whole tokens), upto (running sum), total and block_tokens (at most
    `largest`)."""
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    goals = goals.withColumn("goal", F.round("target").cast("long"))
    goals = goals.withColumns({"upto": F.sum("goal").over(by_rank), "total": F.sum("goal").over(Window.partitionBy(F.lit(1)))})
    return goals.withColumn("block_tokens", F.least(F.greatest(F.ceil(F.col("total") / F.lit(slots)).cast("long"), F.lit(1).cast("long")), F.lit(largest).cast("long")))


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**60, by halves of 30 bits, so that no step leaves 64 bits; slots below 2**60."""
    low = (1 << 30) - 1
    a1, a0 = F.shiftright(slot, 30), slot.bitwiseAND(F.lit(low))
    g1, g0 = F.lit(GOLDEN >> 30), F.lit(GOLDEN & low)
    middle = F.shiftleft((a0 * g1 + a1 * g0).bitwiseAND(F.lit(low)), 30)
    return (a0 * g0 + middle).bitwiseAND(F.lit((1 << RING_BITS) - 1))


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, rank, block): which block of which source's stream each slot takes; each slot has one owner. goals: as from
    in_blocks."""
    spark = goals.sparkSession
    slots = goals.agg(F.ceil(F.max(F.col("total") / F.col("block_tokens"))).cast("long")).first()[0] or 0
    point = lambda c: F.floor(c / F.col("total") * F.lit(float(1 << RING_BITS))).cast("long")
    goals = goals.filter("goal > 0").withColumns({"lo": point(F.col("upto") - F.col("goal")), "hi": point(F.col("upto"))})
    cells = goals.filter("lo < hi").select("rank", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.shiftright("u", CELL_BITS))
    dealt = points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "rank", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    dealt = cut(running_start(dealt.withColumn("one", F.lit(1).cast("long")), ["rank"], "chunk", ["slot"], "one", "block").select("slot", "rank", "block"), "mix-slots")
    alone = goals.join(dealt.select("rank").distinct(), "rank", "left_anti").select((F.lit(slots) + F.col("rank")).cast("long").alias("slot"), "rank", F.lit(0).cast("long").alias("block"))
    return dealt.union(alone)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: float = 2.0, slots: int = 1 << 18, seed: int = 0, largest: int = 1024,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two DataFrames: (documents, slices).

    documents: doc_id, source, size (words), start (of the document in its source's shuffled stream), and the
    source's rank, source_size, target, b (tokens of a block) and goal (the target in whole tokens, which the source's
    slices hold exactly). slices: (slot, rank, doc_id, start, epoch, first, length): slot takes `length` words of the
    document from its word `first` on. Null text has size 0 and takes no part; a null source is a source. Rows that
    repeat an id count apart. No document is taken more than max_repeat times. An empty table gives empty results.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))
    sized = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("order"),
    ).withColumn("bucket", F.shiftright("order", BUCKET_BITS)), "mix-sizes")
    goals = cut(in_blocks(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), tuple(weights), share, max_repeat), slots, largest), "mix-goals", small=True)
    placed = running_start(sized, ["source"], "bucket", ["order", "doc_id", "size"], "size", "start")
    documents = cut(placed.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "start", "rank", "source_size", "target", F.col("block_tokens").alias("b"), "goal"), "mix-places")
    dealt = cut(schedule(goals), "mix-schedule")
    last = cut(dealt.groupBy("rank").agg(F.max("block").alias("last")), "mix-last", small=True)
    stream = documents.filter("size > 0").select(
        "rank", "doc_id", "start", "size", "b", "goal", "source_size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(max_repeat) - 1).cast("long"))).alias("epoch"),
    ).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
    # What comes after the last block's first word belongs to it.
    stream = stream.filter("at < goal").join(last, "rank")
    pieces = stream.withColumn("block", F.explode(F.sequence(F.expr("least(at div b, last)"), F.expr("least((at + size - 1) div b, last)"))))
    end = F.least(F.col("at") + F.col("size"), F.when(F.col("block") < F.col("last"), (F.col("block") + 1) * F.col("b")), F.floor(F.col("source_size") * F.lit(float(max_repeat))).cast("long"), F.col("goal"))
    pieces = pieces.withColumn("lo", F.greatest(F.col("at"), F.col("block") * F.col("b"))).withColumn("length", end - F.col("lo")).filter("length > 0")
    slices = pieces.join(dealt, ["rank", "block"]).select(
        "slot", "rank", "doc_id", "start", "epoch", (F.col("lo") - F.col("at")).alias("first"), "length")
    return documents, slices


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Whole documents of the mix, with all their columns: a document stands once for each time that the block
    with its first word is scheduled. Rows that share an id, null ones too, are repeated alike; documents without words
    (null, empty or blank text) are out; a null source is a source. An empty table gives an empty result."""
    documents, slices = mix(docs, id_col=id_col, **options)
    times = slices.filter("first = 0").groupBy("rank", "start").agg(F.count("*").cast("int").alias("n"))
    times = documents.filter("size > 0").join(times, ["rank", "start"]).groupBy(F.col("doc_id").alias("_id")).agg(F.max("n").alias("_n"))
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"))
    rows = held.join(cut(times, "mix-times"), F.col("id").eqNullSafe(F.col("_id")))
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("doc.*")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    """Documents without words take 0; each source's taken words are its target, rounded."""
    documents, slices = mix(table(spark, sf_dir, "documents"))
    # A document with words is known by its place in its source's stream.
    taken = slices.groupBy(F.col("rank").alias("_r"), F.col("start").alias("_s")).agg(F.sum("length").alias("taken"))
    on = (F.col("rank") == F.col("_r")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("_s"))
    return documents.join(taken, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 8))::BIGINT AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)] AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS want FROM s),
l AS (SELECT *, (want - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap / weight <= level AS capped FROM l),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap ELSE weight * max(level) FILTER (WHERE NOT capped) OVER () END AS target FROM c),
g AS (SELECT *, round(target)::BIGINT AS goal FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM d),
x AS (SELECT p.doc_id, p.size, g.source_size, g.target, p.st, goal AS upto FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, upto - st)) + greatest(0, least(size, upto - source_size - st)))::BIGINT AS taken FROM x
"""
