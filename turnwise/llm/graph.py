"""Connected components of a graph of edges, by alternating stars, all in DataFrame operations.

A round of large and small stars hangs every node's larger neighbours on its smallest one; the number of rounds grows with the
logarithm of the longest chain.  Each round is written to the shared folder, so lineage stays short and nothing comes to the driver but two sums.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove


def _star(edges: DataFrame) -> DataFrame:
    """One round.  A star's centre may have a third of all edges: minima are tables of their own, so both sides of each join are
    shuffled for it and the centre's edges can be split over tasks."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    large = cut(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
    # now b is the smaller one: hang all smaller neighbours of a node, and itself, on the smallest
    small = cut(large.groupBy("a").agg(F.min("b").alias("m")), "small")
    down = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    new = cut(down.unionByName(small.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), "edges")
    for t in (least, large, small):
        remove(spark, t)
    return new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge; root is the smallest node of the component.  edges: (a, b), a != b."""
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        new = _star(now)
        new_state = _state(new)
        remove(spark, now)
        now = new
        if new_state == state:
            break
        state = new_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
