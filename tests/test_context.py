"""Retrieval in stages, walks over pages, and other functions that SQL is a poor judge of, against plain walks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import texts as T
from lodestrata.operators import chunking, curation, documents, graph, knowledge, relations, retrieval
from lodestrata.operators import context as C


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0


def walk_stages(q, chunks, ontology, k, default):
    """One question through all stages, in plain loops. The similarity counts ids other than the question's own."""
    near = lambda rows, n: sorted(rows, key=lambda c: (-cosine(q["qvec"], c["vec"]), c["id"]))[:n]
    chunks = [c for c in chunks if c["id"] != q["qid"]]
    summaries = [c for c in chunks if c["chunk_type"] != "detail"]
    nav = near([c for c in summaries if c["year"] == q["year"]], 10) if q["year"] else []
    nav = nav or near(summaries, 10)
    scope = list(dict.fromkeys(c["pub"] for c in nav))[: C.NAV_PUBS]
    if not scope:
        return [("flat_fallback", 1, c["id"]) for c in near(chunks, k)]
    for p in ontology:
        if p not in scope:
            scope.append(p)
    year = q["year"] if q["year"] and q["year"] <= default else None
    main = near([c for c in chunks if c["pub"] in scope and (year is None or c["year"] == year)], k)
    have = {c["pub"] for c in main}
    back = near([c for c in chunks if c["pub"] in scope and c["pub"] not in have], max(5, k)) if q["year"] else []
    have |= {c["pub"] for c in back}
    sure = []
    for p in sorted(set(scope) - have):
        own = [c for c in chunks if c["pub"] == p]
        rank = {"pub_summary": 0, "section_summary": 1}
        some = sorted((c for c in own if c["chunk_type"] != "detail"), key=lambda c: (rank[c["chunk_type"]], c["id"])) or sorted(own, key=lambda c: c["id"])
        sure += some[:3]
    seen = {c["id"] for c in main + back + sure}
    heads = [c for c in near([c for c in summaries if c["pub"] in scope], 3) if c["id"] not in seen][:2] if seen else []
    out, done = [], set()
    for stage, rows in enumerate((heads, main, back, sure)):
        for c in rows:
            if c["id"] not in done:
                done.add(c["id"])
                out.append(("hierarchical", stage, c["id"]))
    return out


def test_retrieval_in_stages_against_a_plain_walk(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    chunks = [{"id": i, "vec": vec(), "pub": f"p{rng.randrange(9)}", "year": rng.choice([2022, 2024]), "chunk_type": rng.choice(["detail"] * 4 + ["pub_summary", "section_summary"]), "chapter": ""} for i in range(160)]
    chunks += [{"id": 900 + i, "vec": vec(), "pub": "lonely", "year": 2022, "chunk_type": "detail", "chapter": ""} for i in range(4)]
    queries = [{"qid": 1000 + i, "qvec": vec(), "year": [None, 2024, 2026, 2022][i % 4], "topics": ["t"]} for i in range(12)]
    ontology = [("t", "p0", 0), ("t", "lonely", 1)]
    spec = "id long, vec array<double>, pub string, year int, chunk_type string, chapter string"
    kind = "qid long, qvec array<double>, year int, topics array<string>"
    row = lambda d, s: tuple(d[c.split()[0]] for c in s.split(", "))
    a, b = spark.createDataFrame([row(q, kind) for q in queries], kind), spark.createDataFrame([row(c, spec) for c in chunks], spec)
    got = C.retrieve(a, b, spark.createDataFrame(ontology, "topic string, pub string, ord int"), 6).collect()
    for q in queries:
        mine = [(r["mode"], r["stage"], r["id"]) for r in sorted((r for r in got if r["qid"] == q["qid"]), key=lambda r: r["place"])]
        assert mine == walk_stages(q, chunks, ["p0", "lonely"], 6, 2025), q["qid"]
    bare = C.retrieve(a, b.filter("chunk_type = 'detail'"), None, 6).collect()
    assert {r["mode"] for r in bare} == {"flat_fallback"} and len(bare) == 6 * len(queries)


def test_rules_and_sections_of_questions(spark):
    asked = spark.createDataFrame([(1, ["Form1040"], None, 2024), (2, [], "F1040-041", None), (3, [], None, None)], "qid long, form_refs array<string>, code string, year int")
    rules = spark.createDataFrame([(f"R{i}", p, e, s, "text", y) for i, (p, e, s, y) in enumerate([("//IRS1040/A", "F1040-001-01", "WARNING", 2024), ("//IRS1040/B", "F1040-041-01", "ERROR", 2023), ("//IRS8889/C", "F1040-041-02", "INFO", 2024), ("//IRS1040/D", "X", "ERROR", 2024)])], "rule_id string, field_path string, error_code string, severity string, rule_text string, year int")
    got = {(r["qid"], r["id"]): (r["rank"], r["score"], r["text"]) for r in C.rules_for(asked, rules).collect()}
    assert got == {(1, "R3"): (1, 1.0, "[ERROR] R3: text"), (1, "R0"): (2, 0.8, "[WARNING] R0: text"), (2, "R1"): (1, 1.0, "[ERROR] R1: text"), (2, "R2"): (2, 0.8, "[INFO] R2: text")}
    lines = spark.createDataFrame([(1, ["12a", "9"])], "qid long, lines array<string>")
    parts = spark.createDataFrame([(5, "9"), (4, "12a"), (6, "1")], "id long, line string")
    assert [(r["id"], r["score"]) for r in C.sections_for(lines, parts).orderBy("rank").collect()] == [(4, 0.9), (5, 0.9)]


def test_topics_groups_and_prompt(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "qid long, topics array<string>")
    ontology = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("a", "4", 3), ("b", "1", 0), ("b", "5", 1), ("c", "2", 0)], "topic string, pub string, ord int")
    groups = {(r["qid"], r["group"], r["pub"]) for r in C.topic_groups(asked, ontology).collect()}
    assert groups == {(1, 1, "1"), (1, 1, "2"), (1, 1, "3"), (1, 2, "5")}
    scope = spark.createDataFrame([(1, "2")], "qid long, pub string")
    assert [r["pub"] for r in C.topic_pubs(asked, ontology, scope).filter("qid = 1").orderBy("rank").collect()] == ["1", "3", "4", "5"]
    rows = spark.createDataFrame([(1, i, "h", "x\ny" * 3) for i in range(1, 6)], "qid long, rank int, h string, text string")
    made = C.prompt(rows, F.col("h"), budget=40).first()
    assert made["n"] == 2 and made["block"].startswith("[1] h\nx yx yx y\n\n[2] h")


def test_walk_keeps_chunks_under_their_headings(spark):
    body = lambda w, n: "\n\n".join(f"{w} paragraph number {i} has some words in it." for i in range(n))
    pages = [(1, 1, f"Publication 17 (2024)\nChapter 1. First Things 3\n{body('alpha', 3)}\nSome Section Here\n{body('beta', 2)}"), (1, 2, f"{body('gamma', 1)}\nChapter 2. Next Things\n{body('delta', 60)}"), (2, 1, None), (3, 1, "plain words without any heading at all.")]
    frame = spark.createDataFrame(pages, "doc_id long, page_num int, text string")
    rows = documents.walk(frame).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1, 3} and [r["chunk_index"] for r in rows if r["doc_id"] == 1] == list(range(len(rows) - 1))
    first, second, *rest = (r for r in rows if r["doc_id"] == 1)
    assert (first["chapter"], first["section"], first["page_start"]) == ("Chapter 1. First Things", None, 1) and "alpha" in first["text"] and "beta" not in first["text"]
    assert (second["section"], second["page_start"], second["page_end"]) == ("Some Section Here", 1, 2) and "gamma" in second["text"]
    assert rest and {(r["chapter"], r["section"]) for r in rest} == {("Chapter 2. Next Things", None)} and all(r["token_count"] <= chunking.HARD for r in rest)
    assert all(f"number {i} has" in " ".join(r["text"] for r in rest) for i in range(60))


@pytest.mark.parametrize(("heading", "want"), [("Line 1a", "1a"), ("Lines 2a–2b", "2b"), ("Lines 2a-9", "2a"), ("Lines 4a, 4b, and 4c", "4b"), ("Lines 5x and 6", "5x"), ("Income", None), (None, None)])
def test_line_references(spark, heading, want):
    rows = spark.createDataFrame([(heading,)], "h string")
    assert rows.select(documents.line_reference(F.col("h"), ["1a", "2b", "4b"]).alias("l")).first()["l"] == want


def test_plans_of_walks_stay_small(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    found = graph.reach(edges, 10)
    assert found.count() == sum(min(10, 12 - i) for i in range(12))
    assert len(found._jdf.queryExecution().toString().splitlines()) < 300


def test_upsert_with_columns_and_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k long, x string, y int")
    delta = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (3, "C", 3), (None, "m", 4)], "k long, x string, y int")
    got = sorted(map(tuple, relations.upsert(base, delta, ["k"], order=F.col("y")).collect()), key=str)
    assert got == sorted([(1, "B", 2), (2, "b", 20), (3, "C", 3), (None, "m", 4), (None, "n", 0)], key=str)
    some = sorted(map(tuple, relations.upsert(base, delta.select("k", "x"), ["k"], ["x"]).collect()), key=str)
    assert some == sorted([(1, "B", 10), (2, "b", 20), (3, "C", None), (None, "m", None), (None, "n", 0)], key=str)
    assert relations.upsert(base, delta, ["k"], ["x"], insert=False).count() == 3


def test_terms_in_texts_equal_substring_search(spark):
    """One way for any number of terms, in one block or in many, whatever the terms are made of."""
    given = ["Steel and copper plates", "nothing", None, "", "cost: $% of 5", "a b  c", "ÄÖ überß straße", "ab" * 40]
    terms = [("metal", "steel"), ("metal", "copper p"), ("shape", "late"), ("none", "zinc"), ("sign", "$%"), ("sign", ": $"), ("gap", "  "), ("gap", "b "), ("umlaut", "ÜBER"), ("x", ""), ("x", None), (None, "steel"), ("metal", "Steel"), ("rep", "abab"), ("rep", "baba")]
    texts = spark.createDataFrame(list(enumerate(given)), "id long, t string")
    rows = spark.createDataFrame(terms, "topic string, term string")
    known = {(t, w.lower()) for t, w in terms if t and w}
    want = {}
    for i, text in enumerate(given):
        count = Counter(t for t, w in known if w in (text or "").lower())
        want[i] = [t for t, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][:3]
    for block in (200_000, 4):
        assert {r["id"]: r["topics"] for r in knowledge.topics_of(texts, rows, "t", 3, block).collect()} == want
    assert all(r["topics"] == [] for r in knowledge.topics_of(texts, rows.limit(0), "t").collect())



def test_embedding_client_is_retried_and_checked(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", None), (3, None, None)], "id long, text string, embedding array<float>")
    calls = []

    def embed(texts):
        calls.append(1)
        if len(calls) % 2 == 1:
            raise OSError("again")
        return [[float(len(t)), 0.5] for t in texts]

    got = {r["id"]: r["embedding"] for r in knowledge.embedded(rows, embed, 2).collect()}
    assert got[1] == [1.0, 2.0] and got[2] == [1.0, 0.5]
    with pytest.raises(Exception, match="instead of 3"):
        knowledge.embedded(rows, lambda t: [[0.0, 0.0] for _ in t], 3).collect()


def test_completion_client_has_a_fallback(spark):
    rows = spark.createDataFrame([("a",), ("bad",), (None,)], "p string")

    def complete(p):
        if p == "bad":
            raise ValueError
        return p.upper()

    assert [r["x"] for r in rows.select(T.completed(F.col("p"), complete, F.lit("none")).alias("x")).collect()] == ["A", "none", "none"]


def test_json_in_texts(spark):
    cases = [('x [1, 2] y', "[1, 2]"), ('```json\n{"a": [1]}\n```', "[1]"), ('{"a": 1} tail', '{"a": 1}'), ("[broken", None), (None, None)]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r["j"] for r in rows.select(T.json_in(F.col("t")).alias("j")).collect()] == [b for _, b in cases]


def test_logs_only_grow(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    relations.append_log(rows, f"{tmp_path}/log")
    relations.append_log(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").filter("logged_at IS NOT NULL").count() == 2


def test_views_and_filters(spark):
    chunks = spark.createDataFrame([(1, "17", 2024, None, 1, 0), (2, "17", 2024, "pub_summary", 1, -1), (3, "9", 2022, "detail", 2, 0)], "id long, pub string, year int, chunk_type string, page_start int, chunk_index int")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(curation.of_kinds(chunks, ["detail"]).orderBy("id")) == [1, 3] and curation.has_kind(chunks, "pub_summary") and not curation.has_kind(chunks, "other")
    assert ids(curation.summary_chunks(chunks, ["17"], 2024)) == [2] and ids(curation.chosen(chunks, {"pub": ["9"], "year": []})) == [3]
    assert [r["title"] for r in curation.of_publication(chunks, spark.createDataFrame([("17", "T")], "pub string, title string"), "17", 2024).collect()] == ["T", "T"]


def test_composite_parts(spark):
    rows = spark.createDataFrame([(1, 1, 1, 2.0, "p", "detail", "Standard deduction is $1,500", "Deduction", ""), (1, 2, 2, 0.5, "p", "pub_summary", "nothing", None, None), (1, 3, 3, 0.5, "z", "section_summary", "standard", None, None)], "qid long, id long, rank int, score double, pub string, chunk_type string, text string, chapter string, section string")
    rows = rows.withColumns({"terms": F.array(F.lit("standard"), F.lit("deduction")), "wanted": F.array(F.lit("$1,500"))})
    got = {r["id"]: r["composite"] for r in C.by_composite(C.composite(rows, F.col("pub") == "p", F.lit(False))).collect()}
    assert got[1] == pytest.approx(0.15 + 0.30 + 0.15 + 0.15 + 0.10 + 0.15 * 0.5) and got[2] == pytest.approx(0.15 * 0.5 + 0.15 + 0.10 * 0.2) and got[3] == pytest.approx(0.15 * 0.5 + 0.30 * 0.5 + 0.15 * 0.3 + 0.10 * 0.8)


def test_vectors_without_length_or_of_another_length(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(9, None)], "qid long, qvec array<double>")
    assert [(r["id"], r["score"]) for r in retrieval.vector_topk(asked, corpus, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


def test_search_and_contexts_of_questions(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    texts = ["standard deduction amounts", "rental property rules", "depreciation of a car", "filing status and credits"]
    chunks = [(i, vec(), f"{texts[i % 4]} number {i}", f"p{i % 4}", 2023 + i % 3, "detail" if i % 5 else "pub_summary", "Chapter", "") for i in range(60)]
    frame = spark.createDataFrame(chunks, "id long, vec array<double>, text string, pub string, year int, chunk_type string, chapter string, section string")
    asked = [(1, "Compare 2023 and 2025 deductions", vec(), ["d"]), (2, "My client sold a rental property", vec(), ["r", "c"]), (3, "What is the standard deduction?", vec(), ["d"]), (4, "My client asks", vec(), ["d"]), (5, "see line 12A of Form 1040", vec(), [])]
    queries = spark.createDataFrame(asked, "qid long, text string, qvec array<double>, topics array<string>")
    ontology = spark.createDataFrame([("d", "p0", 0), ("r", "p1", 0), ("c", "p2", 0)], "topic string, pub string, ord int")
    got = C.contexts(queries, frame, ontology, 8).collect()
    assert {r["qid"]: r["mode"] for r in got} == {1: "cross_year", 2: "scoped", 3: "hierarchical", 4: "hierarchical", 5: "hierarchical"}
    years = {c[0]: c[4] for c in chunks}
    assert {years[r["id"]] for r in got if r["qid"] == 1} == {2023, 2025} and {r["pub"] for r in got if r["qid"] == 2} == {"p1", "p2"}
    for q in range(1, 6):
        mine = sorted((r for r in got if r["qid"] == q), key=lambda r: r["place"])
        best = sorted(mine, key=lambda r: -r["composite"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1)) and mine[0]["composite"] == best[0]["composite"]
    rules = spark.createDataFrame([("R1", "//IRS1040/A", "F1040-001", "ERROR", "t", 2024)], "rule_id string, field_path string, error_code string, severity string, rule_text string, year int")
    parts = spark.createDataFrame([(7, "12a")], "id long, line string")
    found = C.search(queries, frame, rules, parts, 5).collect()
    mine = sorted((r for r in found if r["qid"] == 5), key=lambda r: r["place"])
    assert [(r["stage"], r["id"]) for r in mine[:2]] == [(0, "R1"), (1, "7")] and all(r["stage"] == 2 for r in mine[2:]) and 5 <= len(mine) - 2 <= 8


def test_topic_pubs_shuffle_one_row_a_question(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, ["x", None, "b"]), (None, ["a"]), (3, None), (4, ["b", "b"])], "qid int, topics array<string>")
    ontology = spark.createDataFrame([("a", "p", 2), ("a", "q", 1), ("b", "q", 0), ("b", "r", None), ("b", None, 5), ("c", "s", 9), (None, "t", 0)], "topic string, pub string, ord int")
    scope = spark.createDataFrame([(1, "q"), (4, None), (4, "r"), (None, "p"), (9, "p")], "qid int, pub string")
    found = C.topic_pubs(asked, ontology, scope, 2, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(qid") == 1
    assert {tuple(r) for r in found.collect()} == {(1, "p", 1), (1, "s", 2), (1, "r", 3), (None, "q", 1), (None, "p", 2), (4, "q", 1), (4, None, 2)}
