"""Connected components in DataFrame operations: every round hooks roots together and shortens the paths to them.

``root`` of a node starts as the node.  A round lets each root that has an edge to a smaller root hang on the smallest such one, and then
replaces each node's root by its root's root until that changes nothing.  The number of rounds grows with the logarithm of a component's size, not with the
length of its longest chain.  Tables of a round go to the shared folder; only counts come to the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keeper


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root is the smallest node of the component.  Loops and repeated edges don't matter."""
    keep = keeper(edges.sparkSession, "components")
    pairs = keep(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "pairs")
    label = keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")), "labels-0")
    turn = 0
    while True:
        of = lambda end: label.select(F.col("node").alias(end), F.col("root").alias("r" + end))  # noqa: B023, E731
        # edges between roots; a root that very many edges meet is combined before the shuffle
        roots = pairs.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb").select("a", "b", F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low"))
        hooks = keep(roots.groupBy("high").agg(F.min("low").alias("to")), f"hooks-{turn}")
        if hooks.isEmpty():
            return label
        depth = 0
        while True:  # hooks on hooks: every high root gets the end of its chain
            onward = hooks.select(F.col("high").alias("to"), F.col("to").alias("then"))
            new = hooks.join(onward, "to", "left").select("high", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved"))
            new = keep(new, f"chains-{turn}-{depth}")
            depth += 1
            hooks = new.select("high", "to")
            if new.filter("moved").isEmpty():
                break
        turn += 1
        label = keep(label.join(hooks, label["root"] == hooks["high"], "left").select("node", F.coalesce("to", "root").alias("root")), f"labels-{turn}")
