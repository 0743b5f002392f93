"""Connected components by alternating large-star and small-star.

Edges are rows; a node's neighbourhood is never collected. Each star
operation is a minimum per node (with map-side combine) joined back to the
edges, so a hub with a third of all edges is one aggregate row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


ROWS_PER_TASK = 50_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than ``rows`` call for (late rounds have few edges)."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: neighbours above each node point to the
    lowest of its neighbourhood. Small: neighbours below, and the node, do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = written(_sized(both.groupBy("u").agg(F.min("v").alias("m"))
                         .select("u", F.least("u", "m").alias("m")), rows), "star-low")
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    out = written(_sized(out.filter(F.col("u") != F.col("v")).distinct(), rows), "star")
    drop_written(low)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the lowest node reachable; only nodes with links appear.

    Rounds go on until neither star changes an edge; every node then points to
    its component directly. Each star is written to the shared folder.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast(
            "decimal(38,0)"))).first())
        if mark == seen:
            return _sized(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), mark[0])
        seen = mark
        half = _star(edges, mark[0], True)
        drop_written(edges)
        edges = _star(half, mark[0], False)
        drop_written(half)
