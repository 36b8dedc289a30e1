"""Connected components by contraction: the links between components shrink each round; nothing reaches the driver.

Cases: nodes are of any type that has an order; a link of a node with itself and repeated links count for nothing; links with a
null end are left out; without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is one node of its component, the same for all of them.

    Each round every root hangs below its smallest neighbour, chains are shortened by pointer jumping, and edges are
    redrawn between roots. A star of any size takes one round; a path of n nodes about log(n). Minima are summed up
    before they are shuffled, so a hub costs no more than other nodes.
    """
    spark = edges.sparkSession
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        if roots is None:
            roots = written(parent.select(F.col("a").alias("node"), F.col("p").alias("root")), "roots")
        else:
            old = roots
            up = parent.select(F.col("a").alias("root"), "p")
            roots = written(old.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
            dropped(spark, old)
        left, right = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, links = links, written(moved, "links")
        dropped(spark, old, parent)
    if roots is None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
