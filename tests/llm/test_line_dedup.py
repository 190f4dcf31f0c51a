import random

import duckdb
import numpy as np
import pytest

from lodestrata.llm import line_dedup
from lodestrata.llm.queries import ORACLES


def brute(rows, run):
    """Every run of lines of at least run words that stands earlier, tried one by one."""
    docs = [[x for x in t.split("\n") if x.split()] for _, t in rows]
    gone = [set() for _ in docs]
    for d, lines in enumerate(docs):
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                part = lines[s : e + 1]
                if sum(len(x.split()) for x in part) >= run and any(docs[k][i : i + len(part)] == part for k in range(d + 1) for i in range(len(docs[k]) - len(part) + 1) if k < d or i + len(part) <= s):
                    gone[d].update(range(s, e + 1))
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_against_every_run(spark, seed):
    rng = random.Random(seed)
    pool = ["one two", "a", "b c d", "e f", "g h i j k", "long " * 9 + "line"]
    rows = []
    for i in range(25):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {rng.random()}" for _ in range(rng.randrange(12))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines[1:1] = other[a : a + rng.randrange(1, 7)]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["deleted"]["lines"]) for r in line_dedup.dedup(docs, run=8).collect()}
    for (i, text), gone in zip(rows, brute(rows, 8), strict=True):
        lines = [x for x in text.split("\n") if x.split()]
        assert got[i][1] == len(gone), (i, text)
        assert [x for x in got[i][0].split("\n") if x.split()] == [x for k, x in enumerate(lines) if k not in gone]


def test_windows_and_picks_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words, hashes = rng.integers(1, 9, 30), [bytes([x]) for x in rng.integers(0, 20, 30)]
        ahead = [(s, next((e for e in range(s, 30) if words[s : e + 1].sum() >= 12), None)) for s in range(30)]
        back = [(next((s for s in range(e, -1, -1) if words[s : e + 1].sum() >= 12), None), e) for e in range(30)]
        assert list(zip(*map(np.ndarray.tolist, line_dedup.windows(words, 12)))) == [x for x in ahead if x[1] is not None]
        assert list(zip(*map(np.ndarray.tolist, line_dedup.windows(words, 12, True)))) == [x for x in back if x[0] is not None]
        want = {max(i for i in range(s, e + 1) if hashes[i] == min(hashes[s : e + 1])) for s, e in ahead if e is not None}
        assert set(line_dedup.picks(hashes, words, 12).tolist()) == want


def test_nulls_repeated_rows_and_clashing_columns(spark):
    passage = "\n".join(f"line {i} of a passage that is long enough to count as one" for i in range(6))
    rows = [(2, "start\n" + passage, 1), (1, passage + "\nend", 2), (None, passage, 3), (3, None, 4), (4, "", 5), (2, "start\n" + passage, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ranges int")
    got = {r["ranges"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {1: "start", 2: passage + "\nend", 3: "", 4: None, 5: "", 6: "start"}
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_sql_agrees_on_a_fixture(spark):
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(15)]
    documents = spark.createDataFrame([(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(60)], "doc_id long, text string").toPandas()
    db = duckdb.connect()
    db.register("documents", documents)
    want = {r[0]: r[1:] for r in db.sql(ORACLES["op5_line_dedup"]).fetchall()}
    got = {r["doc_id"]: (r["text"], r["deleted"]["lines"], r["deleted"]["words"]) for r in line_dedup.dedup(spark.createDataFrame(documents)).collect()}
    assert got == want and any(r[1] for r in want.values())
