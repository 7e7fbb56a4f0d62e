"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import hot_join, saved


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(directed: DataFrame) -> DataFrame:
    """(a, b, m): every pair with the smallest key in the closed neighbourhood of ``a``."""
    low = saved(directed.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
    return hot_join(directed, low.select("a", F.least("a", "m").alias("m"), "n"), "a", "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b); root is the smallest key of its component.

    Each round links all larger neighbours of a node to its smallest one, then all smaller ones, until
    nothing changes; the number of rounds grows with the logarithm of the longest path.  Minima are
    combined before the shuffle, and the joins back shuffle no neighbours of a hub (``hot_join``).
    Edges with a null or with equal ends are ignored.  Every round is written to the shared folder.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    last = _signature(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        small = _stars(down)
        edges = saved(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        now = _signature(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
