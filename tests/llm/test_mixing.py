import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing
from lodestrata.llm.queries import ORACLES


def corpus(n, seed, nulls=False):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["en", "en", "de", "fr"]), f"src{rng.choice([0, 0, 0, 1, 2, 3, 5])}") for i in range(n)]
    return rows + [(n, None, None, None), (None, "w w", "en", "other"), (0, rows[0][1], *rows[0][2:])] * nulls


@pytest.mark.parametrize("seed", range(2))
def test_against_sql(spark, seed):
    documents = spark.createDataFrame(corpus(400, seed), "doc_id long, text string, lang string, source string").toPandas()
    db = duckdb.connect()
    db.register("documents", documents)
    want = sorted(tuple(r) for r in db.sql(f"SELECT doc_id, domain, lang, source, epoch FROM ({ORACLES['op6_mixing']})").fetchall())
    docs = spark.createDataFrame(documents).withColumn("domain", mixing.source_domain())
    got = sorted(tuple(r) for r in mixing.mix(docs, F.col("domain"), mixing.DOMAINS).select("doc_id", "domain", "lang", "source", "epoch").collect())
    assert got == want and max(r[4] for r in got) == 1 and len({r[0] for r in got}) < 400


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10), ("a", "en", "y", 1000), ("a", "de", "x", 1000), ("b", "en", "z", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.quotas(leaves, {}, 800, 1).collect()}
    # a and b 400 each; in a, en and de 200 each; x has only 10 of its 100, its sibling y takes the other 90.
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 190, ("a", "de", "x"): 200, ("b", "en", "z"): 400}
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.quotas(leaves, {"domain": {"b": 9}}, 3000, 1).collect()}
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 990, ("a", "de", "x"): 1000, ("b", "en", "z"): 1000}  # b's shortage goes to a
    assert {r["quota"] for r in mixing.quotas(leaves, {"source": {"x": 0}}, 100, 1).filter("source = 'x' AND lang = 'en'").collect()} == {0}


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 7) for r in corpus(30, 3, True)], "doc_id long, text string, lang string, source string, domain int")
    got = mixing.mix(docs, mixing.source_domain(), {}, epochs=3, out="e").collect()
    assert {"doc_id", "text", "lang", "source", "domain", "e"} == set(got[0].asDict())
    given = [r for r in got if r["doc_id"] == 30]
    assert len(given) == 1  # no tokens: once
    assert sum(r["doc_id"] == 0 for r in got) % 2 == 0  # repeated rows stay or go together
    assert mixing.mix(docs.limit(0), mixing.source_domain(), {}).count() == 0
