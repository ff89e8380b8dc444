"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.sources.tables import keep


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of `pairs` (a, b); the root is the smallest node that it reaches.

    Per round every node hands its larger neighbours its smallest one, then every node joins its smallest one. Smallest
    neighbours are grouped with partial aggregates and joined back, so no hub gathers its edges in a task. Rounds are
    written to the shared folder and end when nothing changes.
    """
    edges = keep(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "pairs")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
        before = state
        around = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        small = around.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = around.where("lo > hi").join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        inner = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        edges = keep(inner.union(small.select("hi", F.col("m").alias("lo"))).distinct(), "pairs")
