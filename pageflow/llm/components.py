"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.sources.shared import staged

#: Rounds grow with the logarithm of the longest chain; only a defect gets here.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for links (a, b): every linked node with the smallest node it reaches.

    Large star: each node's larger neighbours are tied to its smallest
    neighbour; small star: each node ties its smaller neighbours to the smallest.
    The number of links never grows, minima combine before the shuffle, and
    every round is a stored table.  Done when all links lead to a root.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = staged(links.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        down = large.where("a > b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("root"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        tied = small.unionByName(least.select("a", F.col("root").alias("b"))).where("a > b").distinct()
        links = staged(tied, "links")
        inner = links.select(F.col("b").alias("a")).distinct()
        if links.join(inner, "a", "left_semi").isEmpty() and links.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
