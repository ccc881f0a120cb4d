"""Connected components of a link table by alternating stars; only two numbers a round reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectrum.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node that can be reached. Links may repeat,
    point either way or to themselves; no links give no rows. rows: how many links there are about. Each round is
    written to the shared folder, in place of the one before."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = common.written(links.where("a != b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows=rows)
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        old, edges = edges, common.written(_small_star(_large_star(edges)), rows=now[0])
        common.forget(old)
