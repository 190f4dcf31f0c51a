"""Queries: what questions say about themselves, their scope, their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import questions as Q
from lodestrata.operators import context as C
from lodestrata.operators import retrieval as R

from .registry import query, table
from .retrieval import _GROUPED, _LEX, _VEC, _lists, _vectors

_q = lambda s: "'" + s.replace("'", "''") + "'"
_ASKED = [
    "What is the standard deduction this year?", "Last year I sold a house; is section 121 for me?", "I financed a car in 2024, can I claim the deduction in 2025?", "Compare the 2023 and 2025 limits of Roth IRA", "2023 vs 2024 vs 2023",
    "For tax year 2022 or 2021, what about Pub. 590a and Publication 17?", "Form 1040-SR, form 8889 and Schedule c; Schedule A again, Schedule A", "See HSA in 1890", "according to the excerpt, what is the limit?", "The excerpt", "under the excerpt  what does the excerpt state of $1,500 or 15.5% of 12,345?", "", "next year",
]
_ROWS = f"q AS (SELECT conv_id * 100 + turn AS id, coalesce(text, '') AS t FROM conversations WHERE role = 'user' UNION ALL SELECT -n, t FROM (VALUES {', '.join(f'({i}, {_q(t)})' for i, t in enumerate(_ASKED, 1))}) v(n, t))"
_YEARS = rf"list_filter(list_transform(regexp_extract_all(t, {_q(Q.YEAR)}, 1), lambda y: y::INT), lambda y: y BETWEEN 1950 AND 2050)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, t) for i, t in enumerate(_ASKED, 1)], "id long, t string")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("t")).unionByName(own)


@query(rf"""WITH {_ROWS}, y AS (SELECT *, {_YEARS} AS years, try_cast(regexp_extract(t, {_q(Q.ACTION_YEAR)}, 1) AS INT) AS action, try_cast(regexp_extract(t, {_q(Q.TAX_YEAR)}, 1) AS INT) AS named FROM q)
SELECT id, CASE WHEN regexp_matches(lower(t), '\bthis year\b') THEN 2025 WHEN regexp_matches(lower(t), '\blast year\b') THEN 2024 WHEN regexp_matches(lower(t), '\bnext year\b') THEN 2026 WHEN len(years) = 1 THEN years[1]
  WHEN len(years) > 1 AND action BETWEEN 1950 AND 2050 THEN action WHEN len(years) > 1 AND named IS NOT NULL THEN named WHEN len(years) > 1 THEN list_max(years) END AS tax_year,
  CASE WHEN regexp_matches(lower(t), {_q(Q.COMPARING)}) AND len(list_distinct(years)) > 1 THEN array_to_string(list_sort(list_distinct(years)), ',') ELSE '' END AS compared FROM y""")
def question_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", Q.tax_year(F.col("t")).alias("tax_year"), F.array_join(F.transform(Q.comparison_years(F.col("t")), lambda y: y.cast("string")), ",").alias("compared"))


_TOPIC_SQL = ", ".join(f"CASE WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN {_q(n)} END" for n, p in Q.TOPICS)


@query(rf"""WITH {_ROWS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(t, {_q(Q.FORM)}, 1), lambda x: 'Form' || replace(x, '-', '')), list_transform(regexp_extract_all(t, {_q(Q.SCHEDULE)}, 1), lambda x: 'Schedule' || x)))), ',') AS forms,
array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, {_q(Q.PUBLICATION)}, 1), lambda x: lower(x)), lambda x: regexp_full_match(x, '[0-9]+|[0-9]+[ab]')))), ',') AS pubs,
array_to_string(list_sort(list_filter([{_TOPIC_SQL}], lambda x: x IS NOT NULL)), ',') AS topics FROM q""")
def question_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Q.metadata(_asked(spark, sf_dir), "t")
    return made.select("id", F.array_join("form_refs", ",").alias("forms"), F.array_join("pub_refs", ",").alias("pubs"), F.array_join("topic_tags", ",").alias("topics"))


_NORMAL = "t"
for _p in Q.EXCERPTS:
    _NORMAL = f"regexp_replace({_NORMAL}, {_q(_p)}, '', 'g')"
_STOPS = ", ".join(map(_q, Q.STOP_WORDS))
_TERMS_SQL = f"list_filter(regexp_extract_all(lower(t), '[a-z0-9$%]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w))"
_numbers = lambda c: "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all({c}, {_q(p)})" for p in Q.NUMBERS) + "))"


@query(rf"""WITH {_ROWS}, n AS (SELECT id, t, trim(regexp_replace({_NORMAL}, '\s{{2,}}', ' ', 'g')) AS b FROM q)
SELECT id, CASE WHEN b = '' THEN t ELSE upper(b[1]) || b[2:] END AS normalised, array_to_string({_TERMS_SQL}, ' ') AS terms, array_to_string(list_sort({_numbers('t')}), ' ') AS numbers, len(regexp_extract_all(t, {_q(Q.ENTITY)})) AS entities FROM n""")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _asked(spark, sf_dir).select("id", Q.normalised(t).alias("normalised"), F.array_join(Q.terms(t), " ").alias("terms"), F.array_join(F.array_sort(Q.numbers(t)), " ").alias("numbers"), Q.entities(t).alias("entities"))


_PUBS = [("17", "deductions,filing-status", "2024,2025"), ("501", "deductions,dependents", "2025"), ("590a", "ira,contribution-limits", "2024"), ("590b", "ira", "2023"), ("523", "home-sale", "2025"), ("969", "hsa,health-plans", "2022"), ("9", "ira-rollover", "2024")]


@query(rf"""WITH {_ROWS}, m AS (SELECT id, list_sort(list_filter([{_TOPIC_SQL}], lambda x: x IS NOT NULL)) AS topics FROM q), y AS (SELECT *, id % 3 + 2023 AS year FROM m WHERE len(topics) > 0),
p(pub, tags, years) AS (VALUES {', '.join(str(p) for p in _PUBS)}), r AS (SELECT pub, unnest(string_split(tags, ',')) AS tag, years FROM p),
f AS (SELECT id, pub, bool_or(contains(years, year::VARCHAR)) AS fits FROM (SELECT id, year, unnest(topics) AS topic FROM y) JOIN r ON contains(tag, topic) GROUP BY id, pub),
k AS (SELECT *, bool_or(fits) OVER (PARTITION BY id) AS anyfit FROM f), n AS (SELECT id, pub, row_number() OVER (PARTITION BY id ORDER BY regexp_replace(pub, '[^0-9]', '', 'g')::INT, pub) AS n FROM k WHERE fits OR NOT anyfit)
SELECT id, string_agg(pub, ',' ORDER BY n) AS pubs FROM n WHERE n <= 3 GROUP BY id""")
def question_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which publications of a registry a question's topics point to, of its year where there are any."""
    made = Q.metadata(_asked(spark, sf_dir), "t").select(F.col("id").alias("qid"), "topic_tags", F.array().cast("array<string>").alias("pub_refs"), (F.col("id") % 3 + 2023).cast("int").alias("tax_year"), F.lit(0.9).alias("confidence"))
    pubs = spark.createDataFrame(_PUBS, "pub string, tags string, years string").select("pub", F.split("tags", ",").alias("topic_tags"), F.split("years", ",").cast("array<int>").alias("tax_years"))
    return Q.scope(made, pubs).select(F.col("qid").alias("id"), F.array_join("pubs", ",").alias("pubs"))


@query(rf"""WITH {_LEX}, {_GROUPED}, b2 AS (SELECT item_id AS qid, coalesce(text, '') AS t FROM benchmark), bt AS (SELECT qid, {_TERMS_SQL} AS terms, {_numbers('t')} AS wanted FROM b2),
x AS (SELECT a.qid, a.id, a.rank, a.score, a.source, coalesce(d.text, '') AS text, d.lang, terms, wanted, ['pub_summary', 'section_summary', 'detail'][(a.id % 3 + 1)::INT] AS kind FROM a JOIN bt USING (qid) JOIN documents d ON d.doc_id = a.id),
z AS (SELECT *, max((kind = 'detail')::INT) OVER (PARTITION BY qid, source) = 1 AS detailed FROM x)
SELECT qid, id, round(0.15 * least(score, 1) + 0.30 * CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda w: contains(lower(text), w))) / len(terms) ELSE 0 END
 + 0.15 * CASE WHEN len(wanted) > 0 THEN least(len(list_intersect(wanted, {_numbers('text')})) / len(wanted), 1) ELSE least(len(regexp_extract_all(text, {_q(Q.ENTITY)})) / 10.0, 0.5) END
 + 0.15 * CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.6 ELSE 0.3 END + 0.10 * CASE kind WHEN 'detail' THEN 1.0 WHEN 'section_summary' THEN CASE WHEN detailed THEN 0.4 ELSE 0.8 END ELSE CASE WHEN detailed THEN 0.2 ELSE 0.6 END END
 + 0.15 * CASE WHEN len(terms) > 0 THEN greatest(len(list_filter(terms, lambda w: contains(lower(lang), w))), len(list_filter(terms, lambda w: contains(lower(source), w)))) / len(terms) ELSE 0 END + 1e-9, 4) AS composite FROM z""")
def rerank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores of the ten best documents of each benchmark passage."""
    main, _, docs = _lists(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), Q.terms(F.col("text")).alias("terms"), Q.numbers(F.col("text")).alias("wanted"))
    kind = F.get(F.array(F.lit("pub_summary"), F.lit("section_summary"), F.lit("detail")), (F.col("id") % 3).cast("int"))
    rows = main.join(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("pub"), F.col("lang").alias("chapter"), F.col("source").alias("section")), "id").join(asked, "qid").withColumn("chunk_type", kind)
    return C.composite(rows, F.col("pub") == "src0", F.col("pub") == "src1").select("qid", "id", F.round(F.col("composite") + 1e-9, 4).alias("composite"))


@query("WITH w AS (SELECT source AS qid, doc_id AS id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) SELECT qid, id, running FROM w WHERE running <= 12000")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source up to the first that goes over the budget of characters. Lengths aren't negative, so the running sum never falls."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "n_chars")
    return C.within_budget(rows, F.col("n_chars")).select("qid", "id", "running")


@query("SELECT lang AS qid, doc_id AS id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, left(text, 200) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("qid"), F.col("doc_id").alias("id"), "text")
    return C.distinct_prefix(rows, ["id"]).select("qid", "id")


@query(rf"WITH {_LEX}, u AS (SELECT qid, id, rank, 0 AS stage FROM l1 WHERE rank <= 4 UNION ALL SELECT qid, id, rank, 1 FROM l2 WHERE rank <= 6), f AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY stage, rank) AS seen FROM u) SELECT qid, id, stage, row_number() OVER (PARTITION BY qid ORDER BY stage, rank, id) AS place FROM f WHERE seen = 1")
def staged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, other, _ = _lists(spark, sf_dir)
    return C.in_stages([(main, 4), (other, 6)], []).select("qid", "id", "stage", "place")


@query("SELECT doc_id, 'Pub ' || source || coalesce(' — ' || nullif(lang, ''), '') || CASE WHEN n_chars % 5 <> 0 THEN ' — p. ' || (n_chars % 5) ELSE '' END AS citation, sha256(left(trim(replace(text, chr(10), ' ')), 200) || CASE WHEN length(trim(replace(text, chr(10), ' '))) > 200 THEN '…' ELSE '' END) AS snippet_hash FROM documents WHERE source IS NOT NULL")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    return docs.select("doc_id", C.citation("Pub ", F.col("source"), F.col("lang"), F.lit(""), F.col("n_chars") % 5).alias("citation"), F.sha2(C.snippet(F.col("text")), 256).alias("snippet_hash"))


@query(rf"WITH {_VEC}, g(grp, step) AS (VALUES (1, 0), (2, 1), (3, 2)), z AS (SELECT s.*, grp, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, id) AS rank FROM s JOIN g ON dlabel = (qlabel + step) % 8) SELECT qid, grp, id, rank, score FROM z WHERE rank <= 3")
def scoped_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scopes a question, each with its own nearest vectors, in one pass over the corpus."""
    queries, corpus = _vectors(spark, sf_dir)
    scope = queries.filter("qlabel IS NOT NULL").select("qid", "qlabel", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("group")).select("qid", "group", F.lit(3).alias("groups"), ((F.col("qlabel") + F.col("group") - 1) % 8).alias("pub"))
    return C.scoped_topk(queries, corpus.withColumnRenamed("dlabel", "pub"), scope, 10).select("qid", F.col("group").alias("grp"), "id", "rank", "score")


@query(rf"WITH {_VEC}, z AS (SELECT *, 2022 + id % 4 AS year, row_number() OVER (PARTITION BY qid, id % 4 ORDER BY score DESC, id) AS rank FROM s WHERE id % 4 <> 0) SELECT qid, year, id, rank, score FROM z WHERE rank <= 3")
def cross_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf_dir)
    asked = queries.select("qid", "qvec", F.array(F.lit(2023), F.lit(2024), F.lit(2025)).alias("years"))
    return C.across_years(asked, corpus.select("id", "vec", (2022 + F.col("id") % 4).cast("int").alias("year")), 10).select("qid", F.col("year").cast("bigint").alias("year"), "id", "rank", "score")


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as chunks: labels as publications, years and types by id. Questions of ids divisible by 20 ask about 2024 or 2026 or no year."""
    queries, corpus = _vectors(spark, sf_dir)
    kind = F.when(F.col("id") % 10 == 3, "pub_summary").when(F.col("id") % 10 == 7, "section_summary").otherwise("detail")
    chunks = corpus.select("id", "vec", F.concat(F.lit("p"), F.coalesce(F.col("dlabel").cast("string"), F.lit("x"))).alias("pub"), F.when(F.col("id") % 7 == 0, 2022).otherwise(2024).alias("year"), kind.alias("chunk_type"), F.lit("").alias("chapter"))
    year = F.when(F.col("qid") % 60 == 0, 2024).when(F.col("qid") % 60 == 20, 2026)
    return queries.select("qid", "qvec", year.alias("year"), F.array(F.lit("t1")).alias("topics")), chunks


@query()
def hierarchical_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation, drill, backfill, guarantee and summaries before them; a test holds it against a plain walk through the stages for each question."""
    queries, chunks = _library(spark, sf_dir)
    ontology = spark.createDataFrame([("t1", "p0", 0), ("t1", "p9", 1)], "topic string, pub string, ord int")
    return C.retrieve(queries, chunks, ontology, 10)


@query(rf"WITH {_LEX}, {_GROUPED}, c AS (SELECT qid, source, min(rank) AS first FROM a GROUP BY ALL) SELECT qid, source AS citation, row_number() OVER (PARTITION BY qid ORDER BY first, source) AS place FROM c")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, _, docs = _lists(spark, sf_dir)
    return C.sources(main.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("citation")), "id"))


@query(rf"WITH {_VEC} SELECT qid, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE id % 10 IN (3, 7)) WHERE rank <= 8")
def summary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among summaries only."""
    queries, chunks = _library(spark, sf_dir)
    return R.vector_topk(queries.select("qid", "qvec"), chunks.filter(F.col("chunk_type").isin(*C.SUMMARIES)).select("id", "vec"), 8)
