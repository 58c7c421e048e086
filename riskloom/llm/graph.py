"""Connected components as joins and aggregates (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.store import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the ``edges`` (a, b); component is its smallest id.

    Each round replaces edges by stars around smaller ids until nothing
    changes. Rows a round are at most the edges'; a hub's edges meet only in a
    partial aggregate (min) and a join that adaptive execution can split. Null
    ends and self loops are dropped; no edges give an empty result.
    """
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u > v").distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour is linked to the smallest neighbour or self
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour and self is linked to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .where("u > v").distinct())
        new = stored(small, "edges")
        dropped(cur)
        cur = new
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
