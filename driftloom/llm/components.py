"""Connected components of a table of links, by minimum labels with pointer jumping.

Each round takes the least label among a vertex's neighbours (an aggregate, so a hub with any share of the
links is summed where its rows lie) and then the label of that label. Labels live in tables of the shared
folder; the driver sees only the number of labels that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every vertex of the links; the component is its least vertex."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.union(both.select("v", "u")).filter("u <> v").distinct(), "links")
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = cut(labels.join(near, "u").select("u", "l", F.least("l", "m").alias("n")), "step")
        jump = step.select(F.col("u").alias("n"), F.col("n").alias("j"))
        moved = cut(step.join(jump, "n").select("u", F.col("j").alias("n"), (F.col("l") != F.col("j")).alias("moved")), "labels")
        discard(step, labels)
        labels = moved.select("u", F.col("n").alias("l"))
        if moved.filter("moved").isEmpty():
            discard(both)
            return labels.select(F.col("u").alias("v"), F.col("l").alias("component"))
