import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import runs
from lodestrata.llm.queries import QUERIES


def brute_runs(words, min_length, min_exponent):
    """(start, period, length): each stretch of equal words q apart, kept where no smaller q is a period of it."""
    out, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, q, length))
            i = j + 1
    return sorted(out)


def collapse(words, found):
    gone = {i for start, q, length in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n=80):
    rng = random.Random(seed)
    out = ["", " ", "\n\t", "one", "a a a a a a", "a b a b a b a b", "é é é é é é é é"]
    for _ in range(n):
        size, kinds, q = rng.choice([3, 20, 70]), rng.choice([1, 2, 3, 9]), rng.randint(1, 6)
        words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        if rng.random() < 0.6:
            words = [words[i % q] if rng.random() < 0.97 else words[i] for i in range(size)]
        out.append(rng.choice(["", " "]) + "".join(w + rng.choice([" ", "\n", "  ", "\r\n\x0b"]) for w in words))
    return out


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (5, 3)])
def test_all_runs_of_many_texts(spark, min_length, min_exponent):
    given = texts(min_exponent)
    rows = spark.createDataFrame(list(enumerate(given)), "id long, text string").repartition(3)
    got = {r["id"]: r["r"] for r in rows.select("id", runs.periodic_runs("text", min_length, min_exponent).alias("r")).collect()}
    for i, text in enumerate(given):
        words = text.encode().split()
        words = [w.decode() for w in words]
        want = brute_runs(words, min_length, min_exponent)
        assert [(r["start"], r["period"], r["length"]) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == collapse(words, want)


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    long = " ".join(f"w{i % 1013}" for i in range(300_000))
    rows = [(1, None, 5), (1, "", 6), (2, "x y x y x y x y", 7), (2, "x y x y x y x y", 7), (None, long, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = frame.withColumn("r", runs.periodic_runs("text")).collect()
    assert [(r["doc_id"], r["runs"], [tuple(x) for x in r["r"]["runs"]]) for r in got] == [(1, 5, []), (1, 6, []), (2, 7, [(0, 8, 2)]), (2, 7, [(0, 8, 2)]), (None, 8, [(0, 300_000, 1013)])]
    assert [r["r"]["collapsed"] for r in got][:4] == ["", "", "x y", "x y"] and len(got[4]["r"]["collapsed"].split()) == 1013
    assert frame.limit(0).withColumn("r", runs.periodic_runs("text")).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(F.col("text"), 6, 1)


def test_op11(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(9, 200))] + [(-10, "a b c a b c"), (1_000, None), (None, "a a a a a a a"), (7, "b " * 30), (7, "b " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n = len(words)
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        found = brute_runs(words, 6, 4)
        best = max(found, key=lambda r: (r[2], -r[0], -r[1]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
        own = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((i, len(found), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, found).encode()).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 20
