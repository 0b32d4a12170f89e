"""Connected components of a graph given as links, by alternating large and small stars.

Each round points every node's larger neighbours, and then its smaller ones, to the smallest node it
knows; it ends when all that is left are stars around smallest nodes, after a number of rounds that
grows with the logarithm of the largest component. Links are never gathered by node: the smallest neighbour is an aggregate and
is joined back, and each half round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import stage


def _stars(links: DataFrame, smaller: bool) -> DataFrame:
    """links has src > dst. Each node's other ends that are larger (or, if smaller, its smaller ones and itself) get its smallest."""
    if smaller:
        ends = links
    else:
        ends = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # a table of its own, so that the join deals out anew and Spark can split a node with very many links
    least = stage(ends.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("src", "least")), "least")
    joined = ends.join(least, "src")
    if smaller:
        out = joined.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
    else:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    out = out.where("src <> dst")
    return out.distinct() if smaller else out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of a link between two nodes.

    Links of a node with itself and null ends are left out; without links the result is empty.
    """
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    while True:
        now = stage(_stars(now, smaller=False), "large-stars")
        now = stage(_stars(now, smaller=True), "small-stars")
        ends = now.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            break
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
