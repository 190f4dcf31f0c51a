"""Walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def reach(edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) for what each node reaches in at most depth steps, by the shortest way. Each step joins only what was new in the last and is written, so plans stay small."""
    edges = stored(edges.select("src", "dst").distinct())
    front = stored(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")))
    found = front
    for d in range(2, depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def _typed(edges: DataFrame, types: list[str] | None) -> DataFrame:
    rows = edges.select("src", "dst", "type").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return stored(rows.filter(F.col("type").isin(types)) if types is not None else rows)


def _first(edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    own = edges if starts is None else edges.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return own.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("nodes"), F.array("type").alias("types"))


def shortest_paths(edges: DataFrame, depth: int, types: list[str] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, nodes, types) of edges (src, dst, type): of each node that a start (node; by default each source) reaches in at most depth steps over edges of the types, the shortest path; of several the
    least by its nodes, then by its types.

    Semi-naive: a step joins only the nodes that the last one reached first, each with one path, so no more rows stand than there are pairs of start and node. Each step is written. Rows without an end have no part."""
    edges = _typed(edges, types)
    best = F.min(F.struct("nodes", "types")).alias("p")
    front = stored(_first(edges, starts).groupBy("start", "node").agg(best).select("start", "node", F.lit(1).alias("depth"), "p.*"))
    found = front
    for d in range(2, depth + 1):
        ahead = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("types", F.array("type")).alias("types"))
        new = ahead.join(found.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(best)
        front = stored(new.select("start", "node", F.lit(d).alias("depth"), "p.*"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def trails(edges: DataFrame, depth: int, types: list[str] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, nodes, types): all paths of at most depth steps that take no edge twice, as a pattern of variable length matches them. There are as many rows as paths, which may be very many more than nodes."""
    edges = _typed(edges, types)
    front = stored(_first(edges, starts).withColumn("depth", F.lit(1)))
    found = front
    for d in range(2, depth + 1):
        step = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("t"))
        taken = F.transform(F.sequence(F.lit(1), F.size("types")), lambda i: F.struct(F.get("nodes", i - 1).alias("a"), F.get("nodes", i).alias("b"), F.get("types", i - 1).alias("t")))
        ahead = front.join(edges, F.col("node") == F.col("src")).filter(~F.array_contains(taken, step))
        front = stored(ahead.select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("types", F.array("type")).alias("types"), F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.select("start", "node", "depth", "nodes", "types")
