"""Queries: gates over the tables, and the rule language's replay and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import questions as Q
from lodestrata.functions import rule_language as L
from lodestrata.operators import gates as G
from lodestrata.operators import retrieval as R

from .registry import query, table
from .retrieval import _VEC, _vectors

_checks = lambda *c: "SELECT unnest([" + ", ".join(f"'{n}'" for n, _, _ in c) + "]) AS \"check\", unnest([" + ", ".join(f"({v})::DOUBLE" for _, v, _ in c) + "]) AS value, unnest([" + ", ".join(f"coalesce({ok}, false)" for _, _, ok in c) + "]) AS passed"


@query("""WITH c AS (SELECT source, count(*) FILTER (coalesce(trim(text), '') = '') AS b, count(*) FILTER (NOT coalesce(n_chars > 0, false)) AS c, count(*) FILTER (NOT coalesce(doc_id % 50 >= 1, false)) AS e, count(*) FILTER (NOT regexp_matches(format('p{}-2025::{:04d}', source, doc_id), '^p\\w+-\\d{4}::\\d{4}$')) AS f, count(*) FILTER (doc_id % 7 = 0) AS g, count(*) FILTER (doc_id % 26 = 0) AS h, count(*) AS a FROM documents WHERE source IS NOT NULL GROUP BY source),
i AS (SELECT source, count(*) FILTER (n > 1) AS d FROM (SELECT source, doc_id // 2 AS x, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source)
SELECT source AS pub_id, unnest(['A_COUNT', 'D_INDEX', 'B_TEXT', 'C_TOKENS', 'E_PAGES', 'F_IDS', 'G_REFS', 'H_DIMENSION']) AS "check", unnest([a, d, b, c, e, f, g, h])::DOUBLE AS value, unnest([a >= 10, d = 0, b = 0, c = 0, e = 0, f = 0, g = 0, h = 0]) AS passed FROM c JOIN i USING (source)""")
def gate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their sources; every second place is taken twice, some name a form twice, and some have a vector of another length."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("source").alias("pub_id"), F.expr("doc_id DIV 2").alias("chunk_index"), "text", F.col("n_chars").alias("token_count"), (F.col("doc_id") % 50).alias("page_start"), Q.chunk_id(F.col("source"), F.lit(2025), F.col("doc_id")).alias("chunk_id"), F.array(F.lit("Form1"), F.when(F.col("doc_id") % 7 == 0, "Form1").otherwise("Form2")).alias("form_refs"), none.alias("line_refs"), F.when(F.col("doc_id") % 2 == 0, F.array_repeat(F.lit(0.5), F.when(F.col("doc_id") % 26 == 0, 3).otherwise(4))).alias("embedding"))
    return G.chunks_gate(rows, 4)


@query("""WITH e AS (SELECT DISTINCT source AS pub FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'missing'), f AS (SELECT source AS pub, count(*) AS chunks, count(l.doc_id) AS embedded, avg(greatest(1, n_chars // 4)) AS tokens FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source)
SELECT pub, coalesce(chunks, 0) AS chunks, round(coalesce(100 * embedded / chunks, 0) + 1e-9, 1) AS embedded_pct, round(tokens, 6) AS avg_tokens, coalesce(chunks >= 10 AND tokens BETWEEN 50 AND 650, false) AS passed, length(pub) < 5 AS thin FROM e LEFT JOIN f USING (pub)""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    expected = docs.select(F.col("source").alias("pub")).filter("pub IS NOT NULL").distinct().unionByName(spark.createDataFrame([("missing",)], "pub string")).withColumn("page_count", F.length("pub"))
    flagged = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("embedding")).distinct()
    chunks = docs.join(flagged, "doc_id", "left").select(F.col("source").alias("pub"), "embedding", F.greatest(F.lit(1), F.expr("n_chars DIV 4")).alias("token_count"))
    return G.coverage_gate(expected, chunks)


@query("WITH x AS (SELECT count(*) AS n, (count(*) FILTER (lang = 'en') < 3)::INT + (count(*) FILTER (lang = 'de') < 3)::INT + (count(*) FILTER (lang = 'xx') < 3)::INT AS p, (count(*) FILTER (doc_id % 3 = 0) < 1)::INT + (count(*) FILTER (doc_id % 3 = 1) < 1)::INT + (count(*) FILTER (doc_id % 3 = 2) < 1)::INT AS t, median(length(text))::DOUBLE AS q, median(length(text))::DOUBLE AS a, count(text) - count(DISTINCT lower(trim(text))) AS r FROM documents) " + _checks(("A_SIZE", "n", "n >= 40"), ("B_PUBLICATIONS", "p", "p = 0"), ("C_DIFFICULTY", "t", "t = 0"), ("D_QUESTIONS", "q", "q >= 30"), ("E_ANSWERS", "a", "a >= 50"), ("F_REPEATED", "r", "r = 0")) + " FROM x")
def gate_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gold entries of two known languages and one that none has."""
    docs = table(spark, sf_dir, "documents")
    tiers = F.get(F.array(*(F.lit(d) for d in G.DIFFICULTIES)), (F.col("doc_id") % 3).cast("int"))
    return G.gold_gate(docs.select(F.col("text").alias("question"), F.col("text").alias("ground_truth"), F.col("lang").alias("expected_pub"), tiers.alias("difficulty")), ["en", "de", "xx"])


@query(f"WITH {_VEC}, p AS (SELECT vec_id AS qid, label AS pub FROM embeddings WHERE vec_id % 20 = 0 AND label IS NOT NULL), r AS (SELECT qid, rank, score, dlabel FROM v), h AS (SELECT p.qid, min(rank) AS rank FROM p LEFT JOIN r ON r.qid = p.qid AND r.dlabel = p.pub AND rank <= 3 GROUP BY p.qid) SELECT h.qid, h.rank, r.score, coalesce(r.score >= 0.3, false) AS passed FROM h LEFT JOIN r ON r.qid = h.qid AND r.rank = h.rank")
def gate_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each query among those of its three nearest vectors, with a similarity of 0.3."""
    queries, corpus = _vectors(spark, sf_dir)
    found = R.vector_topk(queries.drop("qlabel"), corpus.drop("dlabel"), 10).join(corpus.select("id", F.col("dlabel").alias("pub")), "id").withColumn("text", F.lit(""))
    probes = queries.filter("qlabel IS NOT NULL").select("qid", F.col("qlabel").alias("pub"), F.lit(0.3).alias("min_score"), F.lit(3).alias("within"), F.lit(None).cast("string").alias("contains"))
    return G.probes_gate(probes, found.select("qid", "rank", "pub", "score", "text"))


@query(f"WITH x AS (SELECT count(*) FILTER (floor(s_acctbal / 1000) < {G.CONTEXTS}) AS a, count(*) FILTER (s_suppkey % 10 / 10.0 < {G.LEAST_SCORE}) AS b, count(*) FILTER (10 * (s_suppkey % 20) < {G.ANSWER}) AS c, count(*) FILTER (s_nationkey % 3 < 1) AS d, count(*) FILTER (abs(s_acctbal) > {G.RETRIEVAL_MS}) AS e, count(*) FILTER (5 * abs(s_acctbal) > {G.SYNTHESIS_MS}) AS f FROM supplier) " + _checks(("A_CONTEXTS", "a", "a = 0"), ("B_SCORE", "b", "b = 0"), ("C_ANSWER", "c", "c = 0"), ("D_CITATION", "d", "d = 0"), ("E_RETRIEVAL", "e", "e = 0"), ("F_SYNTHESIS", "f", "f = 0")) + " FROM x")
def gate_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as answers: their balance as the number of contexts and as times, their key as score and length, their nation as citations."""
    took = F.abs("s_acctbal")
    rows = table(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_acctbal") / 1000).alias("contexts"), (F.col("s_suppkey") % 10 / 10.0).alias("min_score"), F.repeat(F.lit("xxxxxxxxxx"), (F.col("s_suppkey") % 20).cast("int")).alias("answer"), (F.col("s_nationkey") % 3).alias("citations"),
        took.alias("retrieval_ms"), (5 * took).alias("synthesis_ms"),
    )
    return G.agent_gate(rows)


@query(f"WITH r AS (SELECT event_type, value > 50 AS ok FROM events WHERE value IS NOT NULL), x AS (SELECT round(avg(ok::INT), 6) AS rate, (SELECT count(*) FROM (SELECT event_type FROM r GROUP BY event_type HAVING count(*) >= 3 AND round(avg(ok::INT), 6) < 0.5)) AS bad FROM r) " + _checks(("ACCURACY", "rate", f"rate >= {G.REVIEW_RATE}"), ("SYSTEMATIC", "bad", "bad = 0")) + " FROM x")
def gate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews of their types: above 50 is right, no value is unreviewed."""
    return G.review_gate(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 50), "event_type", "ok").withColumn("value", F.round("value", 6))


@query(f"WITH {_VEC}, z AS (SELECT e.vec_id, max((qlabel = dlabel)::INT) AS hit FROM embeddings e LEFT JOIN v ON v.qid = e.vec_id WHERE e.vec_id % 20 = 0 GROUP BY e.vec_id), x AS (SELECT round(avg(coalesce(hit, 0)), 6) AS r FROM z) SELECT 'hit_rate' AS \"check\", r AS value, r >= 0.5 AS passed FROM x")
def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit rate of vector search over all queries, half of them at least."""
    queries, corpus = _vectors(spark, sf_dir)
    ranked = R.vector_topk(queries.drop("qlabel"), corpus.drop("dlabel"), 10).join(corpus.select("id", "dlabel"), "id")
    hit = F.col("qlabel") == F.col("dlabel")
    each = queries.select("qid", "qlabel").join(ranked, "qid", "left").groupBy("qid").agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit"), F.count_if(hit).alias("found"), F.lit(1).alias("relevant"))
    return G.rate_gate(R.ranking_metrics(each, []), "hit_rate", 0.5)


@query("WITH x AS (SELECT count(*) FILTER (p_size > 2 AND trim(p_comment) = '') AS e, 0 AS h, count(*) AS n, count(*) FILTER (p_partkey % 2 = 0) AS l, coalesce(avg(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 3 = 0)::INT END), 1) AS r FROM (SELECT p_partkey, p_size, p_name AS p_comment FROM part)) " + _checks(("EMPTY_CONTENT", "e", "e = 0"), ("HEADING_QUALITY", "h", "h = 0"), ("SECTION_COUNT", "n", "n >= 10"), ("LINE_SECTIONS", "l", "l >= 5"), ("FIELD_MAP_RATE", "round(r, 6)", "r >= 0.7")) + " FROM x")
def gate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections: every second is about a line, every third has a field."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("heading"), F.col("p_name").alias("text"), F.col("p_size").alias("level"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("line"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("field_names"))
    return G.sections_gate(rows).withColumn("value", F.round("value", 6))


@query("WITH f AS (SELECT DISTINCT p_brand AS field FROM part), c AS (SELECT DISTINCT p_brand AS field FROM part WHERE p_size > 48 AND p_partkey % 3 = 0), x AS (SELECT round(avg((c.field IS NOT NULL)::INT), 6) AS r FROM f LEFT JOIN c USING (field)) SELECT 'FORMLINE_COVERAGE' AS \"check\", r AS value, r >= 0.7 AS passed FROM x")
def gate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    covered = part.filter("p_size > 48 AND p_partkey % 3 = 0").select(F.array("p_brand").alias("field_names"))
    return G.link_gate(part.select(F.col("p_brand").alias("field")), covered).withColumn("value", F.round("value", 6))


@query("WITH f AS (SELECT unnest(['empty', 'language']) AS \"check\", unnest([doc_id, CASE WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN doc_id END]) AS id, unnest([NOT coalesce(n_chars > 500, false), NOT coalesce(lang IN ('en', 'de'), false)]) AS bad FROM documents), r AS (SELECT \"check\", id::VARCHAR AS id, row_number() OVER (PARTITION BY \"check\" ORDER BY id::VARCHAR) AS n FROM f WHERE bad) SELECT \"check\", string_agg(id, ',' ORDER BY id) AS ids FROM r WHERE n <= 5 GROUP BY \"check\"")
def gate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents that fail each of two checks."""
    checks = {"empty": F.col("n_chars") > 500, "language": F.col("lang").isin("en", "de")}
    return G.failing_rows(table(spark, sf_dir, "documents"), checks, "doc_id").select("check", F.array_join("ids", ",").alias("ids"))


_OLD = {"A": "[l_quantity] <= 45", "B": "If [l_returnflag] = 'R' Then [l_discount] <= 0.05", "C": "[l_tax] <= 0.07"}
_NEW = {"A": "[l_quantity] <= 48", "B": "If [l_returnflag] = 'R' Then [l_discount] <= 0.05", "D": "ABS([l_discount] - [l_tax]) / [l_tax] <= 3"}


@query("WITH f AS (SELECT *, l_quantity > 45 AS a, l_returnflag = 'R' AND l_discount > 0.05 AS b, l_tax > 0.07 AS c, l_quantity > 48 AS a2, l_tax <> 0 AND abs(l_discount - l_tax) / l_tax > 3 AS d FROM lineitem), z AS (SELECT CASE WHEN (a OR b OR c) = (a2 OR b OR d) THEN 'same' WHEN a OR a2 OR d THEN 'expected' ELSE 'unexpected' END AS change FROM f) SELECT change, count(*) AS n FROM z GROUP BY change")
def rule_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of rules over the same records: which outcomes turned, and whether a changed rule explains it."""
    return L.regression(table(spark, sf_dir, "lineitem"), _OLD, _NEW).groupBy("change").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT l_quantity > 45 AS a, l_returnflag = 'R' AND l_discount > 0.05 AS b, l_tax > 0.07 AS c, l_quantity > 48 AS a2, l_tax <> 0 AND abs(l_discount - l_tax) / l_tax > 3 AS d FROM lineitem), x AS (SELECT count(*) FILTER ((a OR b OR c) <> (a2 OR b OR d) AND NOT (a OR a2 OR d)) AS n FROM f) " + _checks(("UNEXPECTED", "n", "n = 0")) + " FROM x")
def gate_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that turned without a changed rule: rule C, which is gone, explains none."""
    return G.regression_gate(L.regression(table(spark, sf_dir, "lineitem"), _OLD, _NEW))


@query("WITH f AS (SELECT l_quantity > 45 AS a, l_returnflag = 'R' AND l_discount > 0.05 AS b, l_tax > 0.07 AS c, l_linestatus = 'O' AS want FROM lineitem), x AS (SELECT round(avg((CASE WHEN a OR b THEN want AND (NOT want OR b) ELSE NOT want END)::INT), 6) AS m FROM f) " + _checks(("ERROR_MATCH", "m", "m >= 1"), ("WARNING_MATCH", "1", "true")) + " FROM x")
def gate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines are expected to be rejected by rule B, others to be accepted; rule C is a warning."""
    opened = F.col("l_linestatus") == "O"
    cases = table(spark, sf_dir, "lineitem").withColumns({"want": F.when(opened, "REJECTED").otherwise("ACCEPTED"), "codes": F.when(opened, F.array(F.lit("B"))).otherwise(F.array().cast("array<string>"))})
    return G.replay_gate(L.replay(cases, _OLD, ["A", "B"], "want", "codes")).withColumn("value", F.round("value", 6))


_TEXT_RULES = {"T1": "[o_orderstatus] = 5", "T2": "If [o_orderpriority] matches pattern '^1' Then [o_orderstatus] < 5", "T3": "If [o_orderstatus] NOT IN ('F', 'O') Then [o_clerk] is present AND [o_totalprice] / 2 / 0 >= 1", "T4": "If [o_orderstatus] != 'F' Then [o_missing] must be attached", "T5": "SUM([o_totalprice], [o_missing]) / [o_custkey] must not exceed 100"}


@query("WITH f AS (SELECT unnest([CASE WHEN o_orderstatus IS NOT NULL THEN 'T1' END, CASE WHEN regexp_matches(o_orderpriority, '^1') AND o_orderstatus IS NOT NULL THEN 'T2' END, CASE WHEN o_orderstatus <> 'F' THEN 'T4' END, CASE WHEN o_custkey <> 0 AND coalesce(o_totalprice, 0) / o_custkey > 100 THEN 'T5' END]) AS rule FROM orders) SELECT rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY rule")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that compare texts with numbers, divide by zero and ask for what isn't there."""
    known = table(spark, sf_dir, "orders")
    rules = {k: r for k, r in _TEXT_RULES.items() if all(f in known.columns or f.startswith("o_missing") for f in L.fields(r))}
    return L.violations(known, rules).select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
