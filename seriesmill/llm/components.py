"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node with an edge to another; component is the smallest node reachable.

    Each round hangs every node's larger neighbours on the smallest neighbour, then every node's smaller ones; rounds end when the edges no longer change, after about log(n) of them. Every round is a table in the shared folder. Nulls and self-links are left out; an empty table gives an empty result.
    """
    edge = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edge, before = materialize(edge, "edges"), None
    while True:
        state = edge.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or not state[0]:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edge.select("v", "v").distinct())
        before = state
        both = edge.union(edge.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = materialize(small.union(least.select("u", "m")).distinct(), "edges")
