"""Connected components of a table of links, by alternating stars.

Each round points every node and its larger neighbours at the smallest node around (large star), then its smaller
neighbours too (small star), and ends in stars around the smallest node of each component; the number of rounds grows with
the logarithm of a component's size.  Rounds are frozen in the shared folder.  No component is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import freeze, gathered


def stars(links: DataFrame, most: int | None = None) -> DataFrame:
    """``a``, ``b`` (undirected links, any order, repeats allowed) to ``node``, ``root`` for every node but the roots.
    ``most`` is about how many links there are, where the caller knows; rounds have tasks by the links counted in the last one."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = freeze(edges if most is None else gathered(edges, most))
    n, seen = edges.count(), None
    while True:
        edges = gathered(edges, n)
        both = gathered(edges.union(edges.select("v", "u").toDF("u", "v")), n)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = gathered(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = gathered(large.join(least, "u"), n).select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = freeze(gathered(small, n))
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, seen = state[0], state
