"""Connected components by repeated contraction, with joins and aggregates only.

In each round every node moves to the neighbour that comes first in an order drawn anew by hash, so
that the nodes left shrink by a constant factor whatever the shape of the graph. Rounds are written
to the shared folder, which cuts lineage and leaves joins whose large keys Spark can split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); the root is any node of the component.

    Direction, loops and repeated edges do not matter; null ends are ignored. No edges, no nodes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(both.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    roots = staged(links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    turn = 0
    while not links.filter("a <> b").isEmpty():
        turn += 1

        def rank(node: str, turn: int = turn):
            return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("h"), F.col(node).alias("v"))

        first = links.groupBy("a").agg(F.min(rank("b")).alias("m"))
        moved = first.select("a", F.least(rank("a"), F.col("m")).getField("v").alias("to"))
        moved = staged(moved, "moved")
        left = links.filter("a <> b").join(moved.withColumnRenamed("to", "x"), "a")
        right = moved.select(F.col("a").alias("b"), F.col("to").alias("y"))
        links_next = left.join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = staged(links_next.distinct(), "links")
        step = moved.select(F.col("a").alias("root"), "to")
        roots = staged(
            roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
    return roots
