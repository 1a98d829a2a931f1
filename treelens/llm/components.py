"""Connected components over edge tables, without collecting anything.

Alternates the large-star and small-star contractions of Kiveris et al.
("Connected Components in MapReduce and Beyond", 2014): every round is two
aggregations with map-side combine and two joins whose skewed keys AQE can
split, and the number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join's sides are plain exchanges and a hub's rows can be split among tasks
    least = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(src, dst)`` long edges -> ``(id, component)`` with the smallest id as component.

    Only nodes on an edge between two different nodes appear; self-loops,
    repeated and null edges are ignored; an empty table gives an empty table.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    current, before = save(pairs.distinct(), name), None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        current = save(_small_star(_large_star(current)), name)
    # The fixed point is a set of stars: one edge from each node to its component.
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
