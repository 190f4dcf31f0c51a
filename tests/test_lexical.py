"""Lexical search over postings against plain BM25, stems, cover density, text ids, and the faults that reviews found."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import curation, knowledge, lexical, relations, retrieval
from lodestrata.operators import context as C

# Words and their stems from the published description of the algorithm.
WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radicalli vileli vietnamization predication operator feudalism decisiveness formaliti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate effective bowdlerize probate rate cease controll roll"
STEMS = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit radic vile vietnam predic oper feudal decis formal sensibl triplic form formal electr electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt homolog commun activ effect bowdler probat rate ceas control roll"


def test_stems():
    assert [lexical.stem(w) for w in WORDS.split()] == STEMS.split()
    assert [lexical.stem(w) for w in ("by", "1040", "w2", "2024s", "limits", "limited", "limiting")] == ["by", "1040", "w2", "2024", "limit", "limit", "limit"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("tax", "limit", "rule", "car", "house", "form") for b in ("", "s", "ing", "ed", "er")] + ["the", "of", "1040"]
    return [(f"p{i % 9}-2024::{i:04d}", " ".join(rng.choice(words[: rng.choice([4, 12, len(words)])]) for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(n)]


def plain(docs, query, stemmed):
    lex = lambda t: [lexical.stem(w) if stemmed else w for w in re.findall("[a-z0-9]+", (t or "").lower()) if not stemmed or w not in lexical.STOP]
    own = [(i, Counter(lex(t))) for i, t in docs]
    mean = sum(sum(c.values()) for _, c in own) / len(own)
    terms = set(lex(query))
    out = {}
    for i, c in own:
        met = [t for t in terms if c[t]]
        if met:
            score = 0.0
            for t in met:
                df = sum(t in x for _, x in own)
                score += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            out[i] = (round(score, 6), len(met), len(terms), sum(c[t] for t in met))
    return out


@pytest.mark.parametrize("stemmed", [True, False])
def test_search_equals_plain_scores(spark, tmp_path, stemmed):
    docs = corpus(900, 1)
    frame = spark.createDataFrame([*docs, (None, "tax")], "id string, text string").repartition(3)
    asked = [("a", "Tax limits of cars"), ("b", "the of"), ("c", None), (None, "tax"), ("d", "forms"), ("e", "housing ruled by a 1040 form, limited"), ("f", "unknown")]
    lexical.write_index(frame, f"file://{tmp_path}/index", stemmed, buckets=8, block=16)
    index = lexical.read_index(spark, f"file://{tmp_path}/index")
    got = {}
    for r in lexical.search(index, spark.createDataFrame(asked, "qid string, text string"), 10).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"], r["matched"], r["terms"], r["occurrences"]))
    for qid, text in asked:
        want = plain(docs, text, stemmed) if qid else {}
        best = sorted(want.items(), key=lambda x: (-x[1][0], x[0]))[:10]
        mine = sorted(got.get(qid, []))
        assert [m[1] for m in mine] == [i for i, _ in best] or [round(m[2], 4) for m in mine] == [round(s[0], 4) for _, s in best], qid
        assert all(m[2] == pytest.approx(want[m[1]][0], abs=2e-6) and m[3:] == want[m[1]][1:] for m in mine)
    assert ("b" in got) == (not stemmed)


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    lexical.write_index(spark.createDataFrame(corpus(300, 2), "id string, text string"), f"file://{tmp_path}/index", buckets=16)
    index = lexical.read_index(spark, f"file://{tmp_path}/index")
    found = lexical.search(index, spark.createDataFrame([("q", "taxes")], "qid string, text string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("bucket#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert found.count() == 5


def test_blocks_that_cannot_win_are_left_out(spark):
    """One document has the rare word very often: with small blocks its own is enough, and the result is the same as with one block of all."""
    docs = [(i, "common " * (1 + i % 3) + "filler " * 30) for i in range(2000)] + [(5000 + i, "common rare " * 20) for i in range(12)]
    frame = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(1, "common rare")], "qid long, text string")
    small, whole = (lexical.search(lexical.build(frame, block=b), asked, 5).select("id", "score", "rank").orderBy("rank").collect() for b in (8, 1 << 20))
    assert small == whole and [r["id"] for r in whole] == [5000, 5001, 5002, 5003, 5004]


def test_cover_density():
    assert lexical.cover_density([[0, 5], [1]]) == pytest.approx(2 / 2 + 2 / 5)
    assert lexical.cover_density([[3, 9]]) == 2.0 and lexical.cover_density([]) == 0.0
    assert lexical.cover_density([[0], [10], [5]]) == pytest.approx(3 / 11)


def test_vectors_with_text_ids_null_queries_and_scopes(spark, monkeypatch):
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 1) for _ in range(5)]
    rows = [(f"p{i % 4}-2024::{i:04d}", vec(), f"p{i % 4}") for i in range(200)] + [(None, vec(), "p0")]
    corpus_ = spark.createDataFrame(rows, "id string, vec array<double>, pub string").repartition(3)
    asked = [("q1", vec()), (None, vec()), (rows[0][0], rows[0][1]), ("q2", None)]
    queries = spark.createDataFrame(asked, "qid string, qvec array<double>")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6)

    def near(q, v, k, ok=lambda p: True):
        return sorted(((0.0 if v is None else cosine(v, r[1]), r[0]) for r in rows if r[0] is not None and r[0] != q and ok(r[2])), key=lambda x: (-x[0], x[1]))[:k]

    for bound in (10_000, 1):
        monkeypatch.setattr(retrieval, "BROADCAST", bound)
        got = {}
        for r in retrieval.vector_topk(queries, corpus_, 4).orderBy("rank").collect():
            got.setdefault(r["qid"], []).append((r["score"], r["id"]))
        assert got == {q: near(q, v, 4) for q, v in asked if q}
    scope = spark.createDataFrame([("q1", "p1"), ("q1", "p3"), (rows[0][0], "p0"), ("zz", "p2")], "qid string, pub string")
    found = retrieval.vector_topk_by_facet(queries, corpus_, 3, "pub", scope).collect()
    assert {(r["qid"], r["pub"], r["id"]) for r in found} == {(q, p, i) for q, p in (("q1", "p1"), ("q1", "p3"), (rows[0][0], "p0")) for _, i in near(q, dict(asked)[q], 3, lambda x, p=p: x == p)}


def test_twenty_thousand_queries_over_text_ids(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"c{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)], "id string, vec array<double>")
    queries = spark.range(20_000).select(F.concat(F.lit("q"), "id").alias("qid"), F.array(*(F.cos(F.col("id") * (j + 1)) for j in range(4))).alias("qvec"))
    found = retrieval.vector_topk(queries, rows, 2)
    assert found.count() == 40_000 and found.filter("rank = 1").count() == 20_000


def test_search_and_contexts_over_text_ids(spark):
    rng = random.Random(6)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    chunks = [(f"p{i % 3}-2024::{i:04d}", vec(), f"limits of {'cars' if i % 2 else 'houses'} {i}", f"p{i % 3}", 2024, "detail" if i % 4 else "pub_summary", "C", "") for i in range(40)]
    frame = spark.createDataFrame(chunks, "id string, vec array<double>, text string, pub string, year int, chunk_type string, chapter string, section string")
    queries = spark.createDataFrame([("u1", "what is the limit of cars", vec(), ["t"]), ("u2", None, vec(), [])], "qid string, text string, qvec array<double>, topics array<string>")
    found = C.search(queries, frame, k=4).collect()
    assert {r["qid"] for r in found} == {"u1", "u2"} and all(r["id"].startswith("p") for r in found)
    ontology = spark.createDataFrame([("t", "p9", 0), ("t", "p2", 1)], "topic string, pub string, ord int")
    assert {r["qid"] for r in C.contexts(queries, frame, ontology, 4).collect()} == {"u1", "u2"}


def test_publications_that_topics_add_have_their_priority(spark):
    """Navigation finds the publications with summaries; the topic adds one that has none, whose chunk must score 0.6 of priority, not 0.3."""
    chunks = [(f"n{i}", [1.0, 0.1 * i], "same text here", "nav", 2024, "pub_summary", "", "") for i in range(2)] + [("a1", [0.9, 0.5], "other text here", "more", 2024, "detail", "", "")]
    frame = spark.createDataFrame(chunks, "id string, vec array<double>, text string, pub string, year int, chunk_type string, chapter string, section string")
    queries = spark.createDataFrame([(1, "hello", [1.0, 0.0], ["t"])], "qid long, text string, qvec array<double>, topics array<string>")
    ontology = spark.createDataFrame([("t", "more", 0)], "topic string, pub string, ord int")
    scope = {r["pub"]: r["added"] for r in C.scope_of(queries.withColumn("year", F.lit(None).cast("int")), frame, ontology).collect()}
    assert scope == {"nav": False, "more": True}
    rows = {r["id"]: r for r in C.contexts(queries, frame, ontology, 5).collect()}
    plain_rows = spark.createDataFrame([(1, [], [], "other text here", 0.87416, "more", "detail", "", "")], "qid long, terms array<string>, wanted array<string>, text string, score double, pub string, chunk_type string, chapter string, section string")
    want = C.composite(plain_rows, F.lit(False), F.lit(True)).first()["composite"]
    low = C.composite(plain_rows, F.lit(False), F.lit(False)).first()["composite"]
    assert abs(rows["a1"]["composite"] - want) < abs(rows["a1"]["composite"] - low)


def test_null_orders_never_wipe_a_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    delta = spark.createDataFrame([(1, "A", None), (2, "B", None), (2, "C", 1), (3, "D", None), (3, "E", None)], "k long, x string, y int")
    got = sorted(tuple(r) for r in relations.upsert(base, delta.select("k", "x"), ["k"], order=None).collect())
    assert got == [(1, "A"), (2, "C"), (3, "E")]
    wide = base.withColumn("y", F.lit(0))
    assert sorted(map(tuple, relations.upsert(wide, delta, ["k"], order=F.col("y")).collect())) == [(1, "A", None), (2, "C", 1), (3, "E", None)]
    maps = spark.createDataFrame([(1, {"a": 1}, 1), (1, {"a": 2}, 2)], "k long, m map<string,int>, y int")
    assert relations.last_rows(maps, ["k"], F.col("y")).first()["m"] == {"a": 2}
    flags = relations.latest_flag(spark.createDataFrame([("a", None), ("b", 1), ("b", None), ("b", 2)], "k string, v int"), ["k"], "v").collect()
    assert sorted((r["k"], r["v"] or 0, r["is_current"]) for r in flags) == [("a", 0, False), ("b", 0, False), ("b", 1, False), ("b", 2, True)]


def test_null_labels_are_no_totals(spark):
    rows = spark.createDataFrame([(None, "simple", "x"), (None, "simple", None), ("17", None, "y"), ("17", "simple", None)], "expected_pub string, difficulty string, verified_by string")
    got = {(r["all_pubs"], r["all_difficulties"], r["expected_pub"], r["difficulty"]): (r["n"], r["verified"]) for r in curation.gold_counts(rows).collect()}
    assert got == {(True, True, None, None): (4, 2), (False, True, None, None): (2, 1), (False, True, "17", None): (2, 1), (True, False, None, None): (1, 1), (True, False, None, "simple"): (3, 1)}
    scores = spark.createDataFrame([(None, 1), ("a", 0)], "level string, score int")
    report = {(r["slice"], r["level"]): r["n"] for r in knowledge.judge_report(scores, ["level"], ["score"], F.col("score") == 1).collect()}
    assert report == {("", None): 2, ("level", None): 1, ("level", "a"): 1}
    results = spark.createDataFrame([(1, None, 0, 1, True, False), (2, 1, 1, 1, False, True), (3, 2, 1, 2, None, None)], "qid int, first_hit int, found int, relevant int, errored boolean, pub_hit boolean")
    (all_,) = retrieval.ranking_metrics(results, []).collect()
    assert (all_["n"], all_["n_errored"], all_["pub_accuracy"], all_["hit_rate"], all_["slice"]) == (3, 1, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), "")


def test_postings_are_made_where_a_block_lies_and_repeated_ids_are_parted(spark):
    docs = spark.range(100).selectExpr("IF(id < 80, 'a', concat('b', id)) AS id", "concat('words word ', id % 3) AS text")
    postings, n, mean = lexical._tables(docs, True, None, 4, 8)
    assert "hashpartitioning(term" not in postings._jdf.queryExecution().executedPlan().toString()
    rows = [r for r in postings.collect() if r["term"] == "word"]
    assert n == 100 and mean == 3.0 and sum(r["n"] for r in rows) == 100 and max(r["n"] for r in rows) <= 64
    assert all(len(r["ids"]) == r["n"] and r["tfs"] == [2] * r["n"] and r["lengths"] == [3] * r["n"] and r["positions"] == [[0, 1]] * r["n"] and r["ids"] == sorted(r["ids"]) for r in rows)
    assert all(abs(r["top"] - 2 * 2.2 / (2 + 1.2)) < 1e-9 for r in rows)
