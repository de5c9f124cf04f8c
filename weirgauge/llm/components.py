"""Connected components of a graph given as edges, by alternating star contraction.

One turn hangs every larger neighbour of a node under the smallest node it knows, then
every node under its smallest smaller neighbour.  Edges never grow in number, long chains
shorten by half or more in a turn, and the last graph is one star for each component.  Each
turn is written to the shared folder, so lineage stays short and a lost executor costs
one turn at most.  A hub of many edges is one key of a join, which the runtime splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v != m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node."""
    down = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(down)
    mark = _mark(now)
    while mark[0]:
        turned = _large_star(now).where("u != v").distinct()
        now = staged(_small_star(turned).where("u != v").distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
