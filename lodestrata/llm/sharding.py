"""Sharding by a k-d tree: rows are split again and again at a distributed weighted median along the widest metadata dimension, until each leaf is a shard.

A point is a group of rows (rows of equal texts, say), at the metadata of its row with the smallest number; its weight is the bytes of its rows. A node that is to
become k shards is cut where floor(k / 2) of k parts of its weight end, so shards come out near equal for any k. Widths are those of the node, each dimension scaled by its
extent in the whole table. Along a dimension points are ordered by a 63-bit key: 31 bits of the coordinate, then 32 bits of the group's hash, so that a value that many points share (a hot
source) is cut as well. The median is found digit by digit for all nodes of a level together: sums of weight by node and digit, running sums over at
most 2048 rows a node, then the same inside the digit in which the cut lies. Where the cut misses its aim by more than SLACK of a shard, as a heavy
group lies across it, the next widest dimensions are tried and the cut that misses least is taken.

A group heavier than a shard would make equal shards impossible: its rows then are points of their own. So is every row without a group.

DataFrame functions only. Groups that hold more than 1/HOT of the rows, HOT at most, are joined by broadcast, all others by a shuffle; tree nodes, fewer than shards, by broadcast.
Slots number the rows of a shard from 0 without gaps: rows are dealt by hash into parts of about PART rows, numbered within each, and the sums of the parts before are added.

Nulls: null coordinates and NaN come before all others; a null size counts 0. Repeated rows are rows of their own (of one group, if they have one). An empty table gives an empty one.
Columns of the rows called shard or slot give way.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import drop_written, fresh, written

SLACK, HOT, PART = 0.01, 1000, 10_000
_BITS = (63, 52, 41, 30, 19, 8, 0)  # digits of a key: from each of these bits up to the one before it, 11 bits at most


def coordinate(df: DataFrame, name: str) -> Column:
    """A number that keeps the order of the column's values: numbers themselves, text by its first six bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        value = F.col(name).cast("double")
    elif kind.typeName() in ("date", "timestamp", "timestamp_ntz", "boolean"):
        value = F.col(name).cast("timestamp" if kind.typeName() != "boolean" else "int").cast("double")
    else:
        value = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.when(~F.isnan(value), value)


def _points(rows: DataFrame, uid: str, size: Column, group: Column | None, dims: Sequence[str], shards: int) -> tuple[DataFrame, DataFrame]:
    """(uid, key of the point) of each row, and the points: key, weight, coordinates x0, x1, ..."""
    xs = [f"x{i}" for i in range(len(dims))]
    own = F.xxhash64(F.lit("row"), uid)
    slim = rows.select(F.col(uid).alias("uid"), own.alias("own"), (own if group is None else F.coalesce(group.cast("bigint"), own)).alias("group"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("weight"), *(coordinate(rows, d).alias(x) for d, x in zip(dims, xs, strict=True)))
    slim = slim_written = written(slim, "shard-rows")
    share = (slim.agg(F.sum("weight")).first()[0] or 0) / shards
    groups = slim.groupBy("group").agg(F.count("*").alias("rows"), F.sum("weight").alias("w"))
    heavy = groups.filter((F.col("w") > share) & (F.col("rows") > 1)).select("group", F.lit(True).alias("heavy"))  # fewer than shards
    slim = slim.join(F.broadcast(heavy), "group", "left")
    keyed = slim.withColumn("key", F.when(F.col("heavy"), F.col("own")).otherwise(F.col("group"))).drop("heavy", "own", "group")
    keyed = written(keyed, "shard-keys")
    drop_written(slim_written)
    points = keyed.groupBy("key").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"), F.min(F.struct("uid", *xs)).alias("at"))
    return keyed.select("uid", "key"), points.select("key", "weight", "rows", *(F.col(f"at.{x}").alias(x) for x in xs))


def _scaled(points: DataFrame, dims: int) -> DataFrame:
    """Coordinates as whole numbers of 31 bits over their extent in the table; null: 0."""
    xs = [f"x{i}" for i in range(dims)]
    ends = points.agg(*(f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def scale(x: str) -> Column:
        low, high = ends[f"lo{x}"], ends[f"hi{x}"]
        if low is None or high == low:
            return F.when(F.col(x).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return F.coalesce(F.floor((F.col(x) / F.lit(high - low) - F.lit(low / (high - low))) * F.lit((1 << 31) - 2)), F.lit(-1)) + 1

    return points.select("key", "weight", "rows", F.lit(0).cast("bigint").alias("node"), *(F.least(F.greatest(scale(x), F.lit(0)), F.lit((1 << 31) - 1)).cast("bigint").alias(x) for x in xs))


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table, fewer rows than there are shards, out of one JSON literal: no Python runs on executors for it."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kinds = ",".join(":".join(c.split()) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def _along(dim: Column, dims: int) -> Column:
    """The 63-bit key along the dimension numbered dim."""
    x = reduce(lambda c, i: c.when(dim == i, F.col(f"x{i}")), range(dims), F.when(F.lit(False), F.lit(0))).cast("bigint")
    return F.shiftleft(x, 32).bitwiseOR(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 32)))


def _cuts(points: DataFrame, asked: list[tuple[int, int, int]], dims: int) -> list[tuple[int, int, int, int]]:
    """asked: (node, dim, aim), fewer than shards. (node, miss, dim, cut) of each: cut is the last key on the left side, at the point where the weight there comes nearest to aim."""
    spark = points.sparkSession
    wanted = F.broadcast(_local(spark, asked, "node bigint, dim int, aim bigint"))
    inside = points.join(wanted, "node").select("node", "weight", _along(F.col("dim"), dims).alias("at"))
    found = [(node, aim, 0, 0, -1) for node, _, aim in asked]
    for top, shift in zip(_BITS, _BITS[1:], strict=False):
        known = F.broadcast(_local(spark, found, "node bigint, aim bigint, prefix bigint, before bigint, previous bigint"))
        here = inside.join(known.select("node", "prefix"), "node").filter(F.shiftright("at", top) == F.shiftright("prefix", top))
        sums = here.groupBy("node", F.shiftright("at", shift).alias("digit")).agg(F.sum("weight").alias("w"), F.min("at").alias("first"), F.max("at").alias("last"))
        run = Window.partitionBy("node").orderBy("digit")
        till = sums.join(known, "node").withColumn("till", F.col("before") + F.sum("w").over(run)).withColumn("earlier", F.coalesce(F.lag("last").over(run), F.col("previous"))).withColumn("at_end", F.lead("digit").over(run).isNull())
        over = till.filter((F.col("till") >= F.col("aim")) | F.col("at_end"))
        rows = over.groupBy("node").agg(F.min_by(F.struct("aim", "first", "last", "earlier", "till", (F.col("till") - F.col("w")).alias("before")), "digit").alias("p")).select("node", "p.*").collect()
        if all(r["first"] == r["last"] for r in rows):  # the cut lies at one point of each node
            break
        found = [(r["node"], r["aim"], r["last"] >> shift << shift, r["before"], r["earlier"]) for r in rows]
    dim_of, out = {node: dim for node, dim, _ in asked}, []
    for r in rows:
        below, above = r["aim"] - r["before"], r["till"] - r["aim"]
        out.append((r["node"], abs(below), dim_of[r["node"]], r["earlier"]) if below <= above and r["earlier"] >= 0 else (r["node"], abs(above), dim_of[r["node"]], r["last"]))
    return out


def _level(points: DataFrame, dims: int, parts: dict[int, int], slack: float) -> dict[int, tuple[int, int]]:
    """(dim, cut) of each node of parts that becomes more than one shard. parts and what comes back have fewer entries than there are shards."""
    xs = [f"x{i}" for i in range(dims)]
    stats = points.filter(F.col("node").isin([n for n, k in parts.items() if k > 1])).groupBy("node").agg(F.sum("weight").alias("w"), *((F.max(x) - F.min(x)).alias(x) for x in xs)).collect()
    order = {r["node"]: sorted(range(dims), key=lambda i, r=r: (-r[xs[i]], i)) for r in stats}
    aims = {r["node"]: r["w"] * (parts[r["node"]] // 2) // parts[r["node"]] for r in stats}
    best: dict[int, tuple[float, int, int]] = {}
    for turn in range(dims):
        asked = [(n, o[turn], aims[n]) for n, o in order.items() if n not in best or best[n][0] > slack]
        if not asked:
            break
        for node, *cut in _cuts(points, asked, dims):
            best[node] = min(best.get(node, (float("inf"), 0, 0)), tuple(cut))
    return {n: (dim, cut) for n, (_, dim, cut) in best.items()}


def tree(points: DataFrame, dims: int, shards: int) -> DataFrame:
    """points (key, weight, node 0, x0, ...) with the shard of each. Written once a level; as many levels as halvings of shards."""
    total = points.agg(F.sum("weight")).first()[0] or 0
    parts, first = {0: shards}, {0: 0}
    while any(k > 1 for k in parts.values()):
        cuts = _level(points, dims, parts, SLACK * total / shards)
        table = [(n, *cuts.get(n, (0, 0))) for n, k in parts.items() if k > 1]
        known = F.broadcast(_local(points.sparkSession, table, "node bigint, dim int, cut bigint"))
        joined = points.join(known, "node", "left")
        right = F.coalesce((_along(F.col("dim"), dims) > F.col("cut")).cast("bigint"), F.lit(0))
        after = written(joined.withColumn("node", F.col("node") * 2 + right).drop("dim", "cut"), "shard-level")
        drop_written(points)
        points = after
        halves = [(n * 2 + side, m, first[n] + (k // 2) * side) for n, k in parts.items() for side, m in ((0, k // 2 if k > 1 else 1), (1, k - k // 2 if k > 1 else 0)) if m]
        parts, first = {n: m for n, m, _ in halves}, {n: f for n, _, f in halves}
    names = F.broadcast(_local(points.sparkSession, list(first.items()), "node bigint, shard int"))
    return points.join(names, "node")


def sharded(rows: DataFrame, size: Column, dims: Sequence[str], shards: int | None = None, target_bytes: int | None = None, group: Column | None = None) -> DataFrame:
    """rows with shard (from 0) and slot (its place in the shard, gapless from 0). size: bytes of a row; dims: metadata columns; group: a number (a hash, say) that rows
    which should stay together have in common. Give shards, or target_bytes for as many shards as that takes."""
    (uid,) = fresh(rows, "uid")
    rows = written(rows.drop("shard", "slot").withColumn(uid, F.monotonically_increasing_id()), "sharding")
    total, n = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, -(-int(total) // target_bytes))
    member, points = _points(rows, uid, size, group, dims, shards)
    points = written(_scaled(written(points, "shard-points"), len(dims)), "shard-nodes")
    placed = written(tree(points, len(dims), shards).select("key", "rows", "shard"), "shard-leaves")
    hot = F.broadcast(placed.filter(F.col("rows") > max(1, n // HOT)).select("key", "shard"))  # HOT rows at most
    cold = member.join(hot.select("key"), "key", "left_anti").join(placed.select("key", "shard"), "key")
    found = member.join(hot, "key").unionByName(cold).select("uid", "shard", F.pmod(F.xxhash64("uid"), F.lit(max(1, n // (shards * PART)))).alias("part"))
    found = written(found, "shard-members")
    counts = found.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = found.join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1)
    return rows.join(numbered.select(F.col("uid").alias(uid), "shard", "slot"), uid).drop(uid)


def write(rows: DataFrame, folder: str, chunk: int = 1_000_000) -> None:
    """Rows of sharded() as Parquet in one folder for each shard, in the order of slots, a file for every chunk of slots."""
    (part,) = fresh(rows, "part")
    dealt = rows.withColumn(part, F.floor(F.col("slot") / chunk)).repartition("shard", part)
    dealt.sortWithinPartitions("shard", part, "slot").drop(part).write.partitionBy("shard").option("maxRecordsPerFile", chunk).parquet(folder)
