"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v).

    Every node learns the least node m among itself and its neighbours (large)
    or its smaller neighbours (small) and hands m to the others. The least
    node comes from a pre-aggregated group, so a hub costs no single task.
    """
    if large:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component: its least node.

    Edges with a null end or two equal ends are ignored. An empty edge table
    gives an empty result. The number of rounds is logarithmic in the longest
    chain; each round's edges are checkpointed, so lineage stays short.
    """
    current = materialised(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and u > v")
        .select("u", "v")
        .distinct()
    )
    state = _state(current)
    while state[0]:
        current = materialised(_star(_star(current, large=True), large=False))
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
