"""Distributed connected components by alternating star contraction.

Each round joins nothing: it regroups edges around the smallest neighbour of
every node ("large star" over larger neighbours, "small star" over smaller
ones) until each node hangs on the smallest node of its component. The least
neighbour is a partial aggregate, so a node with a third of all edges is
summed up map-side; its edges are then met by a join that adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.scratch import discard, materialize, shuffles_removed


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: ``edges`` (u > v); returns edges of the same shape."""
    if larger:  # all neighbours of u; link the larger ones to the least
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("w", "u").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours of u, and u itself, to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable from every node of an edge.

    Null ends and loops are ignored, repeated edges count once, direction does
    not matter. Nodes without edges to others are not returned. Each round is
    written to the shared folder, where it replaces the round before; rounds grow with the logarithm of the size.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    cur = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                      .select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    seen = None
    while True:
        last, cur = cur, materialize(_star(_star(cur, True), False), "star")
        discard(last)
        with shuffles_removed(cur.sparkSession):
            state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
    heads = cur.select("v").distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        heads.select(F.col("v").alias("node"), F.col("v").alias("component")))
