"""Connected components by alternating large-star and small-star steps.

Every step is a ``min`` aggregate (combined before its shuffle) and an
equi-join, so neither a hub nor a component is ever gathered in one place; a
step's edges are checkpointed, which bounds lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node that has an edge, the least node that it reaches.

    ``edges`` has two long columns ``u`` and ``v``; loops, nulls and repeats are ignored.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct().checkpoint()
    mark = _mark(now)
    for _ in range(MOST_STEPS):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.union(low.toDF("u", "v")).distinct().checkpoint()
        mark, before = _mark(now), mark
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct().toDF("node", "component"))
    raise RuntimeError("the components did not settle")
