import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import classify
from lodestrata.functions import rule_language as L
from lodestrata.operators import knowledge, relations, retrieval, sections
from lodestrata.plans.registry import QUERIES
from lodestrata.sources import readers
from lodestrata.streaming import events as E

SF = "/root/testdata/sf0.001"


def fired(spark, rule, **record):
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "double"}
    rows = spark.createDataFrame([tuple(record.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in record.items()))
    return L.violations(rows, {"r": rule}).first()["fired"] == ["r"]


@pytest.mark.parametrize(
    ("rule", "record", "want"),
    [
        ("If [S] IN (1, 2) Then [A] <= 10000", {"S": 1, "A": 10001.0}, True),
        ("If [S] IN (1, 2) Then [A] <= 10000", {"S": 3, "A": 10001.0}, False),
        ("If [S] IN (1, 2) Then [A] <= 10000", {"S": 1, "A": None}, False),
        ("If [S] NOT IN (1, 2) Then [A] is present", {"S": 3, "A": None}, True),
        ("If [A] > 0 Then [IRS8960] must be attached", {"A": 1.0}, True),
        ("If [A] > 0 Then [IRS8960] must be attached", {"A": 1.0, "IRS8960": True}, False),
        ("[A] / [B] <= 1.25", {"A": 5.0, "B": 0.0}, False),
        ("[A] / [B] <= 1.25", {"A": 5.0, "B": 2.0}, True),
        ("[A] = SUM([B], [C])", {"A": 5.0, "B": 5.0}, False),
        ("[A] = MAX(0, [B] - [C])", {"A": 0.0, "B": 1.0, "C": 3.0}, False),
        ("If [A] > 0 OR [B] > 0 AND [C] > 0 Then [D] = 1", {"A": 1.0, "B": 0.0, "C": 0.0, "D": 0.0}, False),
        ("If [N] = 'a AND b' Then [M] matches pattern '^x-[0-9]+$'", {"N": "a AND b", "M": "y-1"}, True),
        ("If [A] = 1 Then [B] = 1 Else [B] = 2", {"A": 2.0, "B": 1.0}, True),
        ("[A] must not exceed [B]", {"A": 2.0, "B": 1.0}, True),
    ],
)
def test_rules(spark, rule, record, want):
    assert fired(spark, rule, **record) is want


def test_relations_with_nulls_and_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k long, v string")
    assert {(r.k, r.change_type) for r in relations.version_diff(old, new, "k", ["v"]).collect()} == {(2, "MODIFIED"), (3, "REMOVED"), (4, "ADDED")}
    assert {tuple(r) for r in relations.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, None)}
    assert relations.upsert(old.limit(0), new, ["k"]).count() == 3


def test_rerank_equals_a_plain_loop(spark):
    rng = random.Random(3)
    for k in (4, 9, 12):
        rows = [(1, i, i + 1, rng.choice("aab")) for i in range(20)]
        got = retrieval.cap_and_backfill(spark.createDataFrame(rows, "qid int, id int, rank int, g string"), "g", k).orderBy("place").collect()
        taken, skipped, n = [], [], {}
        for r in rows:
            n[r[3]] = n.get(r[3], 0) + 1
            (taken if n[r[3]] <= max(3, k // 3) else skipped).append(r[1])
        assert [r.id for r in got] == (taken + skipped)[:k]
    places = retrieval.interleave(spark.createDataFrame([(1, i, i) for i in range(1, 11)], "qid int, id int, rank int")).orderBy("place").collect()
    assert [r.rank for r in places] == [1, 3, 5, 7, 9, 10, 8, 6, 4, 2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_cells_find_nine_of_ten(spark, sf):
    exact = {(r.qid, r.id) for r in QUERIES["vec_topk"](spark, f"/root/testdata/{sf}").collect()}
    near = {(r.qid, r.id) for r in QUERIES["vec_topk_cells"](spark, f"/root/testdata/{sf}").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_only_the_cells_probed_are_read(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("concat('v', vec_id) AS id", "embedding AS vec")
    retrieval.write_cells(rows.unionByName(spark.createDataFrame([(None, [1.0] * 64), ("nothing", None)], "id string, vec array<float>")), f"file://{tmp_path}/c", 16)
    asked = rows.filter("id IN ('v3', 'v7')").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = retrieval.search_cells(f"file://{tmp_path}/c", asked, 5, 3)
    files = {f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"file://{tmp_path}/c/vectors").inputFiles()}
    assert found.count() == 10 and 12 <= len(files) <= 16 and found.filter("qid = id").count() == 0
    assert "cell#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    every = {(r.qid, r.id) for r in retrieval.search_cells(f"file://{tmp_path}/c", asked, 5, 16).collect()}
    assert every == {(r.qid, r.id) for r in retrieval.vector_topk(asked, rows, 5).collect()}



def test_html_sections(spark):
    html = '<head><h2>no</h2></head><p>first</p><h2 id="a">One <b>x</b></h2><p>t1</p><p>t2</p><nav><h3>no</h3></nav><h3>Two</h3>'
    rows = sections.sections(spark.createDataFrame([(1, html), (2, None)], "i int, h string"), "i", "h").orderBy("sequence").collect()
    assert [(r.level, r.anchor, r.heading, r.text) for r in rows] == [("", "", "", "first"), ("h2", "a", "One x", "t1 t2"), ("h3", "", "Two", "")]


def test_intents(spark):
    want = {"Which line do I report wages on?": "form_line", "what triggers this": "rule", "a vs b": "comparison", "how much": "lookup", "my client sold": "scenario", "hello": "general", None: "general"}
    rows = spark.createDataFrame([(k,) for k in want], "q string").select("q", classify.intent(F.col("q")).intent.alias("i")).collect()
    assert {r.q: r.i for r in rows} == want


def test_readers(spark, tmp_path):
    head = "Rule-Id,RULE_TYPE,FORM_FAMILY,FIELD_PATH,RULE_TEXT,RULE_EXPRESSION,ERROR_CODE,SEVERITY,TAX YEAR,SCHEMA_VERSION"
    (tmp_path / "r.csv").write_text(head + '\nR1,MATH,1040, //a/b ,"x, ""y""","If [A] > 1, Then",E1,ERROR,2024,5.2\nR2,MATH,1040,,t,e,E2,ERROR,2024,5.2\nR3,ODD,1040,p,t,e,E3,INFO,2024,5.2\nR4,ALERT,1040,p,t,e,E3,INFO,x,5.2\n')
    rows = readers.read_rules(spark, str(tmp_path / "r.csv")).orderBy("RULE_ID").collect()
    assert [r.reject_reason for r in rows] == [None, "missing value", "rule type", "tax year"] and rows[0].FIELD_PATH == "//a/b" and rows[0].RULE_TEXT == 'x, "y"'
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="SEVERITY"):
        readers.read_rules(spark, str(tmp_path / "bad.csv"))
    gold = spark.createDataFrame([("g1", "q", "t", "p17", ["c1", "c2"], 2024, "simple", ["x"])], "id string, question string, ground_truth string, expected_pub string, gold_chunk_ids array<string>, tax_year int, difficulty string, topic_tags array<string>")
    readers.write_gold(gold, str(tmp_path / "gold"))
    assert readers.read_gold(spark, str(tmp_path / "gold")).collect() == gold.collect()
    hashes = readers.file_hashes(spark, str(tmp_path / "r.csv")).first()
    assert len(hashes.sha256) == 64 and not hashes.is_pdf


def test_streams_equal_their_batch_form(spark, tmp_path):
    events = E.timed(spark.read.parquet(f"{SF}/events.parquet")).repartition(4)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    once = lambda df, mode, at: df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True)
    once(E.windowed(stream, "1 hour", by=("event_type",), late="1 hour"), "complete", "c1").format("memory").queryName("hours").start().awaitTermination()
    want = E.windowed(events, "1 hour", by=("event_type",))
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, want.collect()))

    table = {"now": events.limit(0).select("user_id", "ts", "value"), "n": 0}

    def write(df):
        table["n"] += 1
        df.write.parquet(str(tmp_path / f"base{table['n']}"))
        table["now"] = spark.read.parquet(str(tmp_path / f"base{table['n']}"))

    E.upsert_stream(stream.select("user_id", "ts", "value"), lambda: table["now"], write, ["user_id"], F.struct("ts", "value")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert {(r.user_id, r.ts) for r in table["now"].collect()} == {(r.user_id, r.ts) for r in last.collect()}


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("a b c a",), ("",), (None,)], "t string").select(knowledge.hashed_vector(retrieval.words("t")).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and len(rows[0].v) == 64 and set(rows[1].v) == {0.0} == set(rows[2].v)


def test_matrix_search_equals_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)], rng.choice("xy")) for i in range(60)] + [(60, None, "x"), (61, [0.0] * 4, "y")]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, f string")
    asked = corpus.filter("id % 10 = 0").selectExpr("id AS qid", "vec AS qvec", "f")
    for facet in (None, "f"):
        fast = {tuple(r) for r in retrieval.vector_topk(asked, corpus, 7, facet).collect()}
        monkeypatch.setattr(retrieval, "BROADCAST", 0)
        assert fast == {tuple(r) for r in retrieval.vector_topk(asked, corpus, 7, facet).collect()}
        monkeypatch.undo()
    assert retrieval.vector_topk(asked.limit(0), corpus, 7).count() == 0 == retrieval.vector_topk(asked, corpus.limit(0), 7).count()


@pytest.mark.parametrize("limit", [10_000, 7])
def test_vector_search_in_blocks_and_with_null_facets(spark, monkeypatch, limit):
    """A limit of 7 makes blocks of the 30 queries."""
    monkeypatch.setattr(retrieval, "BROADCAST", limit)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.choice([0, 1, 2, None])) for i in range(150)]
    e = spark.createDataFrame(rows, "id long, vec array<double>, f int")
    asked = e.filter("id % 5 = 0").selectExpr("id AS qid", "vec AS qvec", "f")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    score = lambda a, b: round(sum(x * y for x, y in zip(unit(a), unit(b), strict=True)), 6)
    best = lambda q, among, k: sorted((-score(rows[q][1], v), i) for i, v, _ in among if i != q)[:k]
    asks = range(0, 150, 5)
    want = {(q, i) for q in asks for _, i in best(q, rows, 4)}
    assert {(r["qid"], r["id"]) for r in retrieval.vector_topk(asked.drop("f"), e.drop("f"), 4).collect()} == want
    want = {(q, i) for q in asks for _, i in best(q, [r for r in rows if r[2] == rows[q][2]], 4)}
    assert {(r["qid"], r["id"]) for r in retrieval.vector_topk(asked, e, 4, "f").collect()} == want
    want = {(q, i, None if f is None else str(f)) for q in asks for f in (0, 1, 2, None) for _, i in best(q, [r for r in rows if r[2] == f], 4)}
    assert {(r["qid"], r["id"], r["f"]) for r in retrieval.vector_topk_by_facet(asked.drop("f"), e, 4, "f").collect()} == want


def test_gap_report_names_every_customer(spark, tmp_path):
    n = 150
    spark.range(1, n + 1).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, n + 1).selectExpr("id AS l_orderkey", "7L AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = QUERIES["gap_report"](spark, str(tmp_path)).collect()
    assert (row["l_suppkey"], row["n"], row["questions"]) == (7, n, ",".join(map(str, range(1, n + 1))))


def test_a_task_hands_on_k_rows_a_query_and_facet_however_many_it_reads(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        e = spark.range(1500).selectExpr("id", "array(sin(id), cos(id * 3), sin(id * 7)) AS vec", "CAST(id % 3 AS STRING) AS f").coalesce(1)
        asked = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
        assert retrieval._best_by_block(asked, e, 4, "f", False).count() == 15 * 3 * 4
        assert retrieval._best_by_block(asked, e.drop("f"), 4, None, True).count() == 15 * 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kept_rows_that_are_too_many_are_handed_on_before_the_end(spark, monkeypatch):
    e = spark.range(600).selectExpr("concat('i', id) AS id", "array(sin(id), cos(id * 3)) AS vec", "CAST(id % 3 AS STRING) AS f").coalesce(1)
    asked = e.filter("f = '0'").limit(20).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = {tuple(r) for r in retrieval.vector_topk_by_facet(asked, e, 4, "f").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    monkeypatch.setattr(retrieval, "KEPT", 10)
    try:
        got = retrieval.vector_topk_by_facet(asked, e, 4, "f")
        assert len(want) == 20 * 3 * 4 and {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lexical_search_hands_on_the_best_of_a_task_alone_and_its_portions_are_bounded(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    docs = spark.range(900).selectExpr("id", "concat('the ', repeat('w ', CAST(id % 7 AS INT)), 'x', id % 90, IF(id % 2 = 0, ' of', '')) AS text").coalesce(1)
    asked = spark.range(30).selectExpr("id AS qid", "concat('the of w x', id) AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = retrieval.bm25(asked, docs, 5)
        assert found.count() <= 30 * 10 and retrieval.top(found.select("qid", "id", "score"), 5).count() == 30 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(retrieval, "CELLS", 1000)
    batch = pa.RecordBatch.from_pydict({"terms": pa.array([[0, 1], [], [1], [0]] * 20, pa.list_(pa.int32()))})
    ends = np.array([0, 400, 430])
    parts = list(retrieval._portions(batch, ends, 10))
    assert sum((p["terms"].to_pylist() for p in parts), []) == batch["terms"].to_pylist()
    assert all(len(p) <= 100 and sum(ends[t + 1] - ends[t] for x in p["terms"].to_pylist() for t in x) <= 1000 for p in parts)


def test_compressed_contexts_have_whole_texts(spark):
    """A context has the whole text of its document, and those of one source the whole texts of all of them."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    best = {}
    for r in QUERIES["bm25_topk"](spark, SF).collect():
        best.setdefault(r["qid"], set()).add(r["id"])
    got = {}
    for r in QUERIES["compressed_contexts"](spark, SF).collect():
        got.setdefault(r["qid"], []).append(r)
    assert got.keys() == best.keys() and any(len(rows) < len(best[q]) for q, rows in got.items())
    for q, rows in got.items():
        assert all(r["text"] == texts[r["id"]] or r["text"].startswith(texts[r["id"]] + "\n\n") for r in rows)
        assert all(any(texts[i] in r["text"] for r in rows) for i in best[q])
        assert sum(len(r["text"]) for r in rows) == sum(len(texts[i]) for i in best[q]) + 2 * (len(best[q]) - len(rows))
