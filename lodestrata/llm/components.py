"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Only edges move between rounds; nothing is gathered on the driver but a count and a hash of the edge table, which tell when it stands still.
Each round's table is written to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u. Written, so that both sides of the join on u are exchanges that AQE may split at a hub."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    m = F.least("u", "m")
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), m.alias("v")).filter("u <> v").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    rest = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable. Loops, repeats and either direction are fine; edges with a null end are none."""
    now = written(edges.filter("u <> v").select("u", "v"), "edges")
    state = None
    while True:
        for step in (_large_star, _small_star):
            after, low = step(now)
            after = written(after, "edges")
            drop_written(low)
            drop_written(now)
            now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
