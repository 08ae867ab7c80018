"""Connected components over an edge table, by alternating large-star and small-star passes.

Every pass is a partially aggregated ``groupBy`` and an equi-join; a component never meets in one task,
and AQE can split a hub's rows. Each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that an edge with two different ends touches.

    ``component`` is the smallest node reachable. Null ends and loops are no edges; repeated edges count
    once; an empty table gives an empty result.
    """
    u, v = F.col(a), F.col(b)
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = stored(now, "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
