"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import save


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): every node with an edge, and the least node of its component.

    A round of both stars links each node to smaller neighbours only, until
    nothing changes; rounds grow with the logarithm of the component's size.
    Both are one aggregation to the least neighbour and one join back, so no
    node's neighbours are gathered, however many. Each round is written to the
    shared folder: a lost executor costs a round at most.
    """
    now = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum((F.hash("a", "b")).cast("long"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a")).distinct()
        before = state
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        now = save(down.union(least.select("m", "u")).filter("a < b").distinct(), "edges")
