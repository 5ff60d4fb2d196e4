"""Connected components of a graph of any size by alternating star operations.

Large star hangs all larger neighbours of a vertex on the least vertex it knows, small star does
the same with the smaller ones (Kiveris et al., Connected Components in MapReduce and Beyond, 2014).
No vertex needs its neighbours in one task: each step is an aggregate by vertex and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v, after one star operation."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges if small else edges.unionByName(back)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = around.join(least, "u")
    if small:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its least vertex) of every vertex with an edge to another one."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now, "graph")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    state = print_of(now)
    while state[0]:
        now = written(_star(_star(now, False), True), "graph")
        after = print_of(now)
        if after == state:
            break
        state = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
