"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Alternating star rounds: each node hangs its larger neighbours, then its smaller ones, on the
    smallest node it knows. Aggregates have partial results and the joins are by node, so a hub's
    links are never gathered. Every round is written to the shared folder, which cuts the lineage.
    Links with a null end or between a node and itself count for nothing; no links give no rows.
    """
    rows = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("_ok"))
    edges = stage(rows.where("_ok").drop("_ok").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = stage(_small_star(_large_star(edges)), "stars")
    inner = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return inner.unionByName(tops)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()
