"""Connected components of an edge table by alternating stars.

A large star points each larger neighbour of a node to the smallest node around
it, a small star does so for smaller neighbours. Rounds repeat until the edges
are stars; their number grows with the logarithm of a component's size. Minima
are combined before the shuffle and joined back, so a hub with a third of all
edges is a skewed join, which AQE splits, and not one large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._shared import materialise, remove


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) edges with ``m``: the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least, _ = materialise(least, "least")  # a table, so that both sides of the join have shuffles of their own, which AQE can split
    return edges.join(least, edges["u"] == least["w"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``edges``: its component's smallest node.

    Edges are undirected; those with a null end or equal ends are left out,
    repeated ones count once, other columns are ignored. Nodes without an edge
    aren't in the result; no edges give an empty one.
    """
    step = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    step = step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = materialise(step, "edges")
    digest = F.bit_xor(F.xxhash64("u", "v"))
    before = current.agg(F.count("*"), digest).first()
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large.where("u > v"))
        pointed = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        following, new_path = materialise(pointed.where("u <> v").distinct(), "edges")
        after = following.agg(F.count("*"), digest).first()
        remove(current.sparkSession, path)
        current, path, done, before = following, new_path, tuple(after) == tuple(before), after
        if done:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
