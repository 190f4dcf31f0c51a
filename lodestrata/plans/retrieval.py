"""Queries: vector and lexical search, fusion, reranking, metrics of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import questions as Q
from lodestrata.operators import context as C
from lodestrata.operators import lexical as L
from lodestrata.operators import retrieval as R
from lodestrata.operators.stored import scratch, stored

from .registry import query, table

_VEC = """
s AS (SELECT q.vec_id AS qid, d.vec_id AS id, q.label AS qlabel, d.label AS dlabel,
        round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
      FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10)
"""
_LEX = """
qt AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM benchmark),
qn AS (SELECT qid, count(*) AS terms FROM qt GROUP BY qid),
b AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM b),
h AS (SELECT term, id, any_value(length) AS length, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM b) WHERE term IN (SELECT term FROM qt) GROUP BY term, id),
k AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean FROM h, n GROUP BY term, n, mean),
m AS (SELECT qid, id, any_value(terms) AS terms, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score, count(*) AS matched FROM qt JOIN k USING (term) JOIN h USING (term) JOIN qn USING (qid) GROUP BY qid, id),
l1 AS (SELECT * FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM m) WHERE rank <= 10),
l2 AS (SELECT * FROM (SELECT qid, id, round(matched / terms, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(matched / terms, 6) DESC, id) AS rank FROM m) WHERE rank <= 10)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 20, over all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("dlabel"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark passages as questions: the ranking by BM25, that by the share of words found, and the documents."""
    docs = table(spark, sf_dir, "documents")
    found = stored(R.bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), docs.select(F.col("doc_id").alias("id"), "text"), 10))
    return R.top(found.select("qid", "id", "score"), 10), R.top(found.select("qid", "id", (F.col("matched") / F.col("terms")).alias("score")), 10), docs


@query(f"WITH {_VEC} SELECT qid, id, rank, score FROM v")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf_dir)
    return R.vector_topk(queries.drop("qlabel"), corpus.drop("dlabel"), 10)


@query(f"WITH {_VEC} SELECT qid, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE qlabel = dlabel) WHERE rank <= 5")
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search within the query's own facet."""
    queries, corpus = _vectors(spark, sf_dir)
    return R.vector_topk(queries.filter("qlabel IS NOT NULL").withColumnRenamed("qlabel", "label"), corpus.withColumnRenamed("dlabel", "label"), 5, "label")


@query(f"WITH {_VEC}, g AS (SELECT qid, dlabel, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, dlabel) AS r FROM s GROUP BY qid, dlabel) SELECT qid, id, rank, score FROM (SELECT s.qid, s.id, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, id) AS rank FROM s JOIN g ON g.qid = s.qid AND g.dlabel = s.dlabel AND g.r <= 2) WHERE rank <= 10")
def navigate_then_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the two facets that hold the best matches, then the ten best within them."""
    queries, corpus = _vectors(spark, sf_dir)
    best = R.vector_topk_by_facet(queries.drop("qlabel"), corpus, 10, "dlabel")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("facet_no"))
    scope = best.filter("rank = 1").withColumn("facet_no", F.col("dlabel").cast("int")).withColumn("r", F.row_number().over(w)).filter("r <= 2").select("qid", "dlabel")
    return R.top(best.join(scope, ["qid", "dlabel"], "left_semi").select("qid", "id", "score"), 10)


@query()
def vec_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over a written index by the 44 of 64 cells nearest to a query, as many as these vectors, which lie about evenly in all directions, need; tests hold its recall against vec_topk at two sizes."""
    queries, corpus = _vectors(spark, sf_dir)
    path = scratch(spark, "cells")
    R.write_cells(corpus.drop("dlabel"), path, 64)
    return R.search_cells(path, queries.drop("qlabel"), 10, 44)


@query(f"WITH {_LEX} SELECT qid, id, rank, round(score + 1e-9, 4) AS score FROM l1")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)[0].withColumn("score", F.round(F.col("score") + 1e-9, 4))


@query(f"WITH {_LEX}, u AS (SELECT qid, id, rank, 0 AS l FROM l1 UNION ALL SELECT qid, id, rank, 1 FROM l2), f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(l * 1000 + rank) AS first, count(*) AS lists FROM u GROUP BY qid, id) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank, lists FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(list(_lists(spark, sf_dir)[:2]))


_GROUPED = "a AS (SELECT l1.*, source FROM l1 JOIN documents ON doc_id = id), o AS (SELECT l2.*, source FROM l2 JOIN documents ON doc_id = id)"


@query(f"WITH {_LEX}, {_GROUPED}, x AS (SELECT o.*, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS e FROM o WHERE score >= 0.05 AND NOT EXISTS (SELECT 1 FROM a WHERE a.qid = o.qid AND a.id = o.id) AND EXISTS (SELECT 1 FROM a WHERE a.qid = o.qid AND a.source = o.source)) SELECT qid, id, rank, source, EXISTS (SELECT 1 FROM o WHERE o.qid = a.qid AND o.id = a.id) AS hybrid FROM a UNION ALL SELECT x.qid, id, n + e, source, false FROM x JOIN (SELECT qid, max(rank) AS n FROM a GROUP BY qid) USING (qid) WHERE e <= 3")
def augment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, other, docs = _lists(spark, sf_dir)
    source = docs.select(F.col("doc_id").alias("id"), "source")
    return R.augment(main.join(source, "id"), other.join(source, "id"), "source").select("qid", "id", "rank", "source", "hybrid")


@query(f"WITH {_LEX}, {_GROUPED}, c AS (SELECT qid, id, source, rank, row_number() OVER (PARTITION BY qid, source ORDER BY rank, id) > 3 AS over FROM a), p AS (SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY over, rank, id) AS rank FROM c), t AS (SELECT * FROM p WHERE rank <= 8) SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= 3 OR rank % 2 = 1 THEN rank ELSE 2 * n - rank END) AS place FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM t)")
def rerank_cap_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best with at most three of a source before the rest fill up, then best rows first and last."""
    main, _, docs = _lists(spark, sf_dir)
    grouped = main.join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    kept = R.cap_and_backfill(grouped, "source", 8).withColumn("rank", F.col("place"))
    return R.interleave(kept).select("qid", "id", "source", "place")


@query(f"WITH {_VEC}, z AS (SELECT e.vec_id AS qid, e.label, e.vec_id % 3 AS third, min(rank) FILTER (qlabel = dlabel) AS first_hit, count(*) FILTER (qlabel = dlabel) AS found, any_value(c.n) - 1 AS relevant FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c USING (label) LEFT JOIN v ON v.qid = e.vec_id WHERE e.vec_id % 20 = 0 GROUP BY ALL) SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(third) = 0 THEN 'third' ELSE '' END AS slice, label, third, count(*) FILTER (third = 2) AS n_errored, round(avg(coalesce(first_hit = 1, false)::INT), 6) AS pub_accuracy, count(*) AS n, round(avg((first_hit IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr, round(avg(coalesce(found / nullif(relevant, 0), 0)), 6) AS recall FROM z GROUP BY GROUPING SETS ((), (label), (third))")
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate, MRR and recall of vec_topk: relevant are the vectors with the query's label. Queries without a result count. A first hit at rank 1 stands for the expected publication, a third of the queries for errored ones."""
    queries, corpus = _vectors(spark, sf_dir)
    ranked = R.vector_topk(queries.drop("qlabel"), corpus.drop("dlabel"), 10).join(corpus.select("id", "dlabel"), "id")
    judged = queries.select("qid", "qlabel").join(ranked, "qid", "left")
    hit = F.col("qlabel") == F.col("dlabel")
    each = judged.groupBy("qid", F.col("qlabel").alias("label")).agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit"), F.count_if(hit).alias("found"))
    counts = corpus.groupBy(F.col("dlabel").alias("label")).agg((F.count("*") - 1).alias("relevant"))
    judged = each.join(counts, "label").withColumn("third", F.col("qid") % 3).withColumns({"errored": F.col("third") == 2, "pub_hit": F.col("first_hit") == 1})
    return R.ranking_metrics(judged, ["label", "third"]).select("slice", "label", "third", "n", "n_errored", "pub_accuracy", "hit_rate", "mrr", "recall")


def _stems(source: str) -> str:
    """CTEs s0 to s9 (word, w): Porter's steps over the words of a table."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def case(rules: list[tuple[str, str, str]], then: str = "w") -> str:
        met = lambda e, c: " AND ".join(f"regexp_matches(left(w, length(w) - {len(e)}), {q(x)})" for x in c.split(" ")) if c else "true"
        return "CASE " + " ".join(f"WHEN ends_with(w, {q(e)}) THEN CASE WHEN {met(e, c)} THEN left(w, length(w) - {len(e)}) || {q(to)} ELSE {then} END" for e, c, to in rules) + " ELSE w END"

    tidy = f"CASE WHEN right(c, 2) IN ('at', 'bl', 'iz') THEN c || 'e' WHEN length(c) > 1 AND right(c, 1) = substr(c, -2, 1) AND regexp_matches(c, '[^aeiouylsz]$') THEN left(c, length(c) - 1) WHEN regexp_matches(c, {q(L.SHORT)}) THEN c || 'e' ELSE c END"
    last = f"CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, length(w) - 1), {q(L.M1)}) OR (regexp_matches(left(w, length(w) - 1), {q(L.M_ONE)}) AND NOT regexp_matches(left(w, length(w) - 1), {q(L.SHORT)}))) THEN left(w, length(w) - 1) ELSE w END"
    steps = [
        f"s0 AS (SELECT DISTINCT word, word AS w FROM {source})",
        f"s1 AS (SELECT word, {case([('sses', '', 'ss'), ('ies', '', 'i'), ('ss', '', 'ss'), ('s', '', '')])} AS w FROM s0)",
        f"s2 AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') THEN w ELSE {case([('ing', L.HAS_VOWEL, ''), ('ed', L.HAS_VOWEL, '')])} END AS c FROM s1)",
        f"s3 AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN {case([('eed', L.M0, 'ee')])} WHEN c = w THEN w ELSE {tidy} END AS w FROM s2)",
        f"s4 AS (SELECT word, {case([('y', L.HAS_VOWEL, 'i')])} AS w FROM s3)",
        *(f"s{5 + i} AS (SELECT word, {case(r)} AS w FROM s{4 + i})" for i, r in enumerate((L._RULES_2, L._RULES_3, L._RULES_4))),
        f"s8 AS (SELECT word, {last} AS w FROM s7)",
        f"s9 AS (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN ends_with(w, 'll') AND regexp_matches(w, {q(L.M1)}) THEN left(w, length(w) - 1) ELSE w END AS w FROM s8)",
    ]
    return ", ".join(steps)


_LEXEMES = f"""t AS (SELECT 'q' || item_id AS id, 0 AS side, text FROM benchmark UNION ALL SELECT 'p' || source || '::' || doc_id, 1, text FROM documents),
x AS (SELECT id, side, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM t), y AS (SELECT * FROM x WHERE word NOT IN ({", ".join(f"'{w}'" for w in L.STOP)})), {_stems("y")},
z AS (SELECT id, side, w AS term, count(*) AS tf FROM y JOIN s9 USING (word) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), len AS (SELECT id, sum(tf) AS length FROM z WHERE side = 1 GROUP BY id), mean AS (SELECT coalesce(sum(length), 0) / (SELECT n FROM n) AS mean FROM len),
df AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM z WHERE side = 1 GROUP BY term), q AS (SELECT id AS qid, term, count(*) OVER (PARTITION BY id) AS terms FROM z WHERE side = 0),
sc AS (SELECT qid, d.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS matched, any_value(terms) AS terms, sum(tf)::BIGINT AS occurrences FROM q JOIN df USING (term) JOIN z d ON d.term = q.term AND d.side = 1 JOIN len ON len.id = d.id, mean GROUP BY qid, d.id)"""


@query(f"WITH {_LEXEMES} SELECT qid, id, rank, round(score + 1e-9, 4) AS score, matched, terms, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10")
def lexical_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed search over a written index with ids that are texts: the index is made once, and the searches read the buckets of their terms."""
    path = scratch(spark, "lexical-index")
    L.write_index(table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "source", F.lit("::"), F.col("doc_id").cast("string")).alias("id"), "text"), path)
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), "text")
    found = L.search(L.read_index(spark, path), asked, 10)
    return found.select("qid", "id", "rank", F.round(F.col("score") + 1e-9, 4).alias("score"), "matched", "terms", "occurrences")


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions out of benchmark passages and chunks out of documents, both with the vectors of their number; chunks have ids as chunk_id makes them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    asked = table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), "text", F.col("vec").alias("qvec"))
    chunks = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(Q.chunk_id(F.col("source"), F.lit(2024), F.col("doc_id")).alias("id"), "vec", "text", F.col("source").alias("pub"), F.col("lang").alias("chapter"), "doc_id")
    return asked, chunks


_MERGED = f"""d0 AS (SELECT printf('p%s-2024::%04d', source, doc_id) AS id, text, source AS pub, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE source IS NOT NULL), a0 AS (SELECT 'q' || item_id AS qid, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, pub, round(list_dot_product(a0.embedding::DOUBLE[], d0.embedding::DOUBLE[]) / (sqrt(list_dot_product(a0.embedding::DOUBLE[], a0.embedding::DOUBLE[])) * sqrt(list_dot_product(d0.embedding::DOUBLE[], d0.embedding::DOUBLE[]))), 6) AS score FROM a0, d0)) WHERE rank <= 10),
{_LEX.replace('benchmark', 'a0').replace('item_id', 'qid').replace('documents', 'd0').replace('doc_id AS id', 'id').split('l1 AS')[0].rstrip().rstrip(',')},
w AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(round(score, 6) / (round(score, 6) + 1), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS r0 FROM m) WHERE r0 <= 10)) WHERE rank <= 10),
x AS (SELECT w.*, row_number() OVER (PARTITION BY w.qid ORDER BY w.rank, w.id) AS e FROM w JOIN d0 USING (id) WHERE w.score >= 0.05 AND NOT EXISTS (SELECT 1 FROM v WHERE v.qid = w.qid AND v.id = w.id) AND EXISTS (SELECT 1 FROM v WHERE v.qid = w.qid AND v.pub = d0.pub))"""


@query(f"WITH {_MERGED} SELECT qid, 0 AS stage, rank::INT AS place, id FROM v UNION ALL SELECT x.qid, 0, (n + e)::INT, id FROM x JOIN (SELECT qid, max(rank) AS n FROM v GROUP BY qid) USING (qid) WHERE e <= 3")
def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of each question, with at most three that only its words find, over ids that are texts."""
    asked, chunks = _chunks(spark, sf_dir)
    return C.search(asked, chunks.filter("pub IS NOT NULL").select("id", "vec", "text", "pub"), k=10).select("qid", "stage", "place", "id")


@query()
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of each question, by the kind of question; tests hold the parts against plain walks and SQL."""
    asked, chunks = _chunks(spark, sf_dir)
    text = F.concat(F.when(F.pmod(F.xxhash64("qid"), F.lit(3)) == 0, "Compare 2023 and 2024 for ").when(F.pmod(F.xxhash64("qid"), F.lit(3)) == 1, "My client sold ").otherwise("What is "), F.coalesce("text", F.lit("")))
    own = chunks.filter("pub IS NOT NULL").withColumn("year", F.when(F.col("doc_id") % 2 == 0, 2024).otherwise(2023)).withColumn("chunk_type", F.when(F.col("doc_id") % 11 == 0, "pub_summary").otherwise("detail")).withColumn("section", F.lit("")).drop("doc_id")
    ontology = spark.createDataFrame([("a", f"src{i}", i) for i in range(3)] + [("b", f"src{i}", i) for i in range(3, 6)], "topic string, pub string, ord int")
    return C.contexts(asked.withColumns({"text": text, "topics": F.array(F.lit("a"), F.lit("b"))}), own, ontology, 10).select("qid", "mode", "id", "pub", "place")


@query("WITH o AS (SELECT r_name AS topic, n_name AS pub, n_nationkey AS ord FROM nation JOIN region ON r_regionkey = n_regionkey), q AS (SELECT c_custkey AS qid, n.n_name AS own, [r.r_name, s.r_name] AS topics FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey JOIN region s ON s.r_regionkey = (n.n_regionkey + 1) % 5), t AS (SELECT qid, own, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos FROM q), p AS (SELECT qid, pub, min(pos * 1000 + ord) AS first FROM t JOIN o USING (topic) WHERE pub <> own GROUP BY ALL) SELECT qid, pub, row_number() OVER (PARTITION BY qid ORDER BY first, pub) AS rank FROM p QUALIFY rank <= 4")
def ontology_pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as publications of their region's topic: of each customer's two topics the first four that are not in scope, which is the own nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ontology = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("topic"), F.col("n_name").alias("pub"), F.col("n_nationkey").alias("ord"))
    after = region.select(((F.col("r_regionkey") + 4) % 5).alias("before"), F.col("r_name").alias("second"))
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(after, F.col("before") == F.col("r_regionkey"))
    asked = table(spark, sf_dir, "customer").join(own, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.array("r_name", "second").alias("topics"), F.col("n_name").alias("pub"))
    return C.topic_pubs(asked, ontology, asked.select("qid", "pub"), most=4)


@query("WITH q AS (SELECT n_nationkey AS qid, 'IRS' || n_regionkey AS path, 'E1' || n_nationkey AS code, CASE WHEN n_nationkey % 3 > 0 THEN 2022 + n_nationkey % 3 END AS year FROM nation), r AS (SELECT 'R' || p_partkey AS id, '//IRS' || (p_size % 10) || '/A' AS path, 'E' || p_partkey AS code, CASE WHEN p_size > 40 THEN 'ERROR' WHEN p_size > 20 THEN 'WARNING' ELSE 'INFO' END AS severity, p_name AS t, 2023 + p_partkey % 2 AS year FROM part), m AS (SELECT DISTINCT qid, id, severity, t FROM q JOIN r ON (contains(r.path, q.path) AND (q.year IS NULL OR q.year = r.year)) OR starts_with(r.code, q.code)) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, id) AS rank, CASE WHEN severity = 'ERROR' THEN 1.0 ELSE 0.8 END::DOUBLE AS score, '[' || severity || '] ' || id || ': ' || t AS text FROM m QUALIFY rank <= 3")
def rules_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules and nations as questions that name a form, a year or the beginning of an error code."""
    n = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(n.alias("qid"), F.array(F.concat(F.lit("Form"), F.col("n_regionkey").cast("string"))).alias("form_refs"), F.concat(F.lit("E1"), n.cast("string")).alias("code"), F.when(n % 3 > 0, 2022 + n % 3).alias("year"))
    key, size = F.col("p_partkey"), F.col("p_size")
    level = F.when(size > 40, "ERROR").when(size > 20, "WARNING").otherwise("INFO")
    rules = table(spark, sf_dir, "part").select(F.concat(F.lit("R"), key.cast("string")).alias("rule_id"), F.concat(F.lit("//IRS"), (size % 10).cast("string"), F.lit("/A")).alias("field_path"), F.concat(F.lit("E"), key.cast("string")).alias("error_code"), level.alias("severity"), F.col("p_name").alias("rule_text"), (2023 + key % 2).cast("int").alias("year"))
    return C.rules_for(asked, rules)


@query("WITH q AS (SELECT n_nationkey AS qid, unnest([n_nationkey::VARCHAR, n_regionkey || 'a']) AS line FROM nation), s AS (SELECT 's' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN (p_size % 5) || 'a' ELSE p_size::VARCHAR END AS line FROM part) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank, 0.9::DOUBLE AS score FROM (SELECT DISTINCT qid, id FROM q JOIN s USING (line)) QUALIFY rank <= 3")
def sections_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections about lines, and nations as questions that name two lines each."""
    key = F.col("p_partkey")
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.array(F.col("n_nationkey").cast("string"), F.concat(F.col("n_regionkey").cast("string"), F.lit("a"))).alias("lines"))
    sections = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), key.cast("string")).alias("id"), F.when(key % 4 == 0, F.concat((F.col("p_size") % 5).cast("string"), F.lit("a"))).otherwise(F.col("p_size").cast("string")).alias("line"))
    return C.sections_for(asked, sections)
