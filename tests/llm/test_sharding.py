import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import sharding
from lodestrata.llm.queries import QUERIES

KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, uid int"


def rows_of(n, seed, hot=0.3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "the same text" if rng.random() < 0.1 else "w" * rng.randint(1, 300)
        out.append((i, text, rng.choice(["en", "en", "de", "fr"]), "src0" if rng.random() < hot else f"src{rng.randint(1, 19)}", len(text), "given", i % 3))
    return out


def whole(spark, frame, shards, **more):
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    return sharding.sharded(frame.withColumn("size", size), F.col("size"), ["n_chars", "lang", "source", "doc_id"], shards=shards, group=F.xxhash64("text"), **more).collect()


def check(got, shards, tolerance):
    loads, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["text"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(loads.values()) / shards
    assert all(abs(loads[k] - mean) <= tolerance * mean for k in range(shards)), loads
    return texts


@pytest.mark.parametrize("shards", [8, 5])
def test_shards_are_near_equal_and_equal_texts_stay_together(spark, shards):
    rows = rows_of(6_000, 1)
    got = whole(spark, spark.createDataFrame(rows, KIND), shards)
    assert sorted(r["doc_id"] for r in got) == list(range(6_000))
    assert all(len(s) == 1 for s in check(got, shards, 0.03).values())
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "uid", "size", "shard", "slot"}


def test_a_group_heavier_than_a_shard_is_split(spark):
    rows = [(i, "copy" * 50 if i % 3 == 0 else f"text {i} " * 25, "en", "src0", 1, None, 0) for i in range(3_000)]
    texts = check(whole(spark, spark.createDataFrame(rows, KIND), 8), 8, 0.03)
    assert len(texts.pop("copy" * 50)) > 1 and all(len(s) == 1 for s in texts.values())


def test_a_cut_is_the_weighted_median_of_the_widest_dimension(spark):
    rows = [(i, i * 10, 3, 1 + i % 7) for i in range(999)]
    frame = spark.createDataFrame(rows, "id long, x long, y long, w long")
    got = {r["id"]: r["shard"] for r in sharding.sharded(frame, F.col("w"), ["y", "x"], shards=2).collect()}
    left = [i for i in got if got[i] == 0]
    assert left == list(range(len(left))) or sorted(left) == list(range(len(left)))  # y has no width, so x is cut
    load = sum(1 + i % 7 for i in left)
    assert abs(load - sum(r[3] for r in rows) / 2) <= 4


def test_nulls_repeats_ties_and_target_bytes(spark):
    rows = [(1, "a", None, None, None, None, None)] * 5 + [(None, None, "en", "src0", 3, "x", 1)] * 4 + [(2, "", "de", "src1", 0, None, 2), (3, "z" * 100_000, "en", "src2", 100_000, None, 2)]
    frame = spark.createDataFrame(rows, KIND)
    got = whole(spark, frame, 3)
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert whole(spark, frame.limit(0), 4) == []
    sized = sharding.sharded(frame.drop("shard"), F.octet_length("text"), ["lang"], target_bytes=40_000).collect()
    assert {r["shard"] for r in sized} <= {0, 1, 2} and len(sized) == len(rows)
    floats = spark.createDataFrame([(float("nan"),), (None,), (1.5,), (-2.0,), (float("inf"),)], "x double")
    assert {r["shard"] for r in sharding.sharded(floats, F.lit(1), ["x"], shards=5).collect()} == set(range(5))


def test_written_shards_are_in_order(spark, tmp_path):
    frame = spark.createDataFrame(rows_of(300, 2), KIND).drop("shard")
    done = sharding.sharded(frame, F.length("text"), ["n_chars"], shards=4)
    sharding.write(done, f"{tmp_path}/out", 50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(4)}
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and slots[0] % 50 == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_kd_sharding"](spark, f"/root/testdata/{sf}").collect()
    assert {r["doc_id"] for r in got} == docs.keys() and len(got) == len(docs)
    loads, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[docs[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    heaviest = max(sum(r["size"] for r in got if docs[r["doc_id"]] == t) for t in set(docs.values())) if sf == "sf0.001" else 0.05 * sum(loads.values()) / 8
    assert max(loads.values()) - min(loads.values()) <= heaviest, loads
