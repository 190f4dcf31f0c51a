"""Typed paths against a plain walk; merges into stored tables; state with timers."""

import os
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, tables


def plain_trails(edges, depth):
    out, front = [], [((s, d), (t,), ((s, d, t),)) for s, d, t in edges]
    for _ in range(depth):
        out += front
        front = [((*n, d), (*t, k), (*used, (s, d, k))) for (n, t, used), (s, d, k) in product(front, edges) if n[-1] == s and (s, d, k) not in used]
    return out


def test_paths_of_variable_length(spark):
    edges = sorted({("a", "b", "S"), ("b", "c", "S"), ("c", "a", "T"), ("b", "c", "T"), ("c", "d", "S"), ("d", "d", "T"), ("d", "e", "U")})
    frame = spark.createDataFrame([*edges, ("a", "b", "S"), (None, "b", "S"), ("b", None, "S")], "src string, dst string, type string")
    want = plain_trails([e for e in edges if e[2] != "U"], 5)
    got = [(tuple(r["nodes"]), tuple(r["types"])) for r in graph.trails(frame, 5, ["S", "T"]).collect()]
    assert sorted(got) == sorted((n, t) for n, t, _ in want) and len(got) == len(set(got))
    short = {}
    for n, t, _ in want:
        key = (n[0], n[-1])
        short[key] = min(short.get(key, (9, n, t)), (len(t), n, t))
    found = graph.shortest_paths(frame, 5, ["S", "T"]).collect()
    assert {(r["start"], r["node"]): (r["depth"], tuple(r["nodes"]), tuple(r["types"])) for r in found} == short and len(found) == len(short)
    only = graph.shortest_paths(frame, 2, starts=spark.createDataFrame([("d",), ("zz",)], "node string")).collect()
    assert {(r["start"], r["node"]) for r in only} == {("d", "d"), ("d", "e")}
    assert graph.shortest_paths(frame.limit(0), 3).count() == 0 == graph.trails(frame, 3, []).count()


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_a_merge_rewrites_only_the_parts_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("n")), path, ["k"], parts=32)
    before = files(path)
    delta = spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (5, "lost", None), (2000, "added", 1), (None, "no key", 1)], "k long, v string, n int")
    assert tables.merge(delta, path, ["k"], "b1", order=F.col("n"))
    after = files(path)
    gone, come = set(before) - set(after), set(after) - set(before)
    assert 1 <= len(gone) <= 2 and 1 <= len(come) <= 2 and all(after[f] == before[f] for f in set(before) & set(after)) and len(before) - len(gone) >= 28
    rows = {r["k"]: (r["v"], r["n"]) for r in tables.read(spark, path).collect()}
    assert rows[5] == ("newer", 2) and rows[2000] == ("added", 1) and len(rows) == 1001 and rows[7] == ("old", 0)
    assert not tables.merge(delta.withColumn("v", F.lit("again")), path, ["k"], "b1", order=F.col("n")) and files(path) == after
    (created, merged) = tables.log(spark, path).collect()
    assert (merged["version"], merged["batch"], merged["rows"], merged["rejected"], len(merged["parts"])) == (1, "b1", 5, 1, len(come)) and created["batch"] == "create"


def test_merges_of_columns_empty_batches_and_repeats_after_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.create(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "c", 3)], "k long, v string, n int"), path, ["k"], parts=4, order=F.col("n"))
    some = spark.createDataFrame([(1, "x"), (9, "y")], "k long, v string")
    assert tables.merge(some, path, ["k"], "b1", ["v"], insert=False)
    assert sorted(map(tuple, tables.read(spark, path).collect())) == [(1, "x", 1), (2, "c", 3)]
    assert tables.merge(some.limit(0), path, ["k"], "b2") and tables.log(spark, path).count() == 3
    full = spark.createDataFrame([(1, "z", 5), (4, "w", 6)], "k long, v string, n int")
    logged, tables._logged = tables._logged, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError, match="lost"):
            tables.merge(full, path, ["k"], "b3")
    finally:
        tables._logged = logged
    assert tables.merge(full, path, ["k"], "b3")
    assert sorted(map(tuple, tables.read(spark, path).collect())) == [(1, "z", 5), (2, "c", 3), (4, "w", 6)]


def test_a_stream_merges_each_micro_batch_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    kind = "k long, v string, n int"
    tables.create(spark.createDataFrame([(1, "a", 0)], kind), path, ["k"], parts=4)
    for i in range(3):
        spark.createDataFrame([(1, f"s{i}", i), (i + 10, "new", i)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables.merge_stream(stream, path, ["k"], "s", F.col("n")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    rows = {r["k"]: r["v"] for r in tables.read(spark, path).collect()}
    assert set(rows) == {1, 10, 11, 12} and rows[1].startswith("s") and tables.log(spark, path).count() == 4


def test_timers_end_stretches_and_old_keys_go(spark, tmp_path):
    from datetime import datetime, timedelta

    from lodestrata.streaming import events as E

    kind = "user string, ts timestamp, value double"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("a", at(0), 1.0), ("a", at(20), None), ("b", at(5), 2.0), (None, at(1), 1.0)], [("b", at(30), 3.0), ("c", at(500), 4.0)], [("d", at(520), 1.0)], [("c", at(530), 1.0), ("e", at(2000), 1.0)], [("f", at(4000), 1.0)], [("f", at(4001), 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = E.idle_sessions(stream, "user", 60, "10 seconds").writeStream.format("memory").queryName("stretches").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["user"], (r["started"] - datetime(2024, 1, 1)).seconds, (r["ended"] - datetime(2024, 1, 1)).seconds, r["n"], r["total"]) for r in spark.table("stretches").collect()}
    assert got >= {("a", 0, 20, 2, 1.0), ("b", 5, 30, 2, 5.0), ("d", 520, 520, 1, 1.0), ("c", 500, 530, 2, 5.0), ("e", 2000, 2000, 1, 1.0)} and not any(g[0] == "f" for g in got)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # f alone: its stretch and its timer
