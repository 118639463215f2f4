"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; a component is called by its smallest node.

    Alternating large-star and small-star steps on the table of links: a step joins each node with the smallest of its
    neighbours, so a node with very many links is a sum, never a list. Every round is written to the shared folder.
    Links with a null end, from a node to itself and repeated links change nothing; no links give no rows.
    """
    folder, turn = shared_folder(links.sparkSession), 0
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges, mark = _written(edges, folder, turn)
    while mark[0]:
        ends = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        swap = F.col("u") < F.col("v")
        small = small.union(lowest.select("u", F.col("m").alias("v"))).where("u != v")
        small = small.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))
        turn += 1
        edges, now = _written(small.distinct(), folder, turn)
        if now == mark:
            break
        mark = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(edges: DataFrame, folder: str, turn: int) -> tuple[DataFrame, tuple]:
    """The stored edges and a mark that tells two sets of edges apart: their number and sums of their hashes."""
    edges = stored(edges, folder, f"edges-{turn}")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
    return edges, tuple(mark)
