"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.sources.store import write_table


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
    return row.n, row.x, row.s


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node. Links are pairs of longs.

    Every round points each neighbour above a node to the smallest node around it, then each node to the smallest
    below it, until nothing changes; then all point to their component. Minima are aggregated, so a node with very
    many links is never one group; each round is a written table.
    """
    edges = write_table(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    seen = _sum(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.filter("a > b")
        least = below.groupBy("a").agg(F.min("b").alias("m"))
        small = (below.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = write_table(small, "links")
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
