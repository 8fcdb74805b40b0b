"""Connected components by alternating star contractions, as joins and aggregations over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (columns a, b) with the smallest node it is connected to: columns id, component.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones; the edge set never
    grows and ends as one star for each component, after a number of rounds logarithmic in the longest chain. The driver
    sees only whether a round changed anything. Null nodes and self loops are ignored; an empty table has no components.
    The result reads a scratch table, named by its ``scratch_path``.
    """
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(small, "hi")
        after = materialize(
            linked.select(F.col("m").alias("lo"), "hi").union(linked.where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct()
        )
        # a star for each component: no node is both a centre and a leaf, and no leaf has two centres
        chained = after.select(F.col("hi").alias("x")).join(after.select(F.col("lo").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        twice = 0 if chained else after.groupBy("hi").count().where("count > 1").limit(1).count()
        release(e)
        e = after
        if not chained and not twice:
            break
    out = e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    out.scratch_path = e.scratch_path
    return out
