"""Connected components by alternating large-star and small-star steps, on tables in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v longs): component is the smallest node reachable.

    Self-loops and repeated edges don't matter; no edges give an empty result. Each step takes minima per node
    (partially aggregated) and joins them back, so a node with very many edges is split like any skewed join."""
    held = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    held = stage(held, "graph-edges")
    state = _state(held)
    while state[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large, "graph-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        held = stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "graph-small")
        before, state = state, _state(held)
        if state == before:
            break
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
