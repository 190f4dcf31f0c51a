"""Queries: samples, neighbours, filters and views of gold sets, rules and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import texts as T
from lodestrata.operators import curation as U
from lodestrata.operators import relations
from lodestrata.operators.retrieval import small
from lodestrata.operators.stored import stored

from .registry import query, table
from .retrieval import _GROUPED, _LEX, _lists

_q = lambda s: "'" + s.replace("'", "''") + "'"


@query("WITH p AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i FROM documents), b AS (SELECT source, doc_id, i // greatest(1, n // 5) AS bucket FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY md5(doc_id || ':42'), doc_id) AS k FROM b WHERE bucket < 5) SELECT source, doc_id, bucket FROM r WHERE k = 1")
def bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source from all over its lengths."""
    return U.bucket_sample(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"], "doc_id", 5).select("source", "doc_id", "bucket")


@query("SELECT item_id FROM benchmark ORDER BY md5(item_id || ':42'), item_id LIMIT 7")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.sample(table(spark, sf_dir, "benchmark").select("item_id"), 7, "item_id")


@query("SELECT source, doc_id, ['simple', 'medium', 'complex'][(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 3 + 1] AS difficulty FROM documents")
def rotated_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rotated(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("SELECT conv_id, turn, array_to_string(list_filter([lag(turn, 2) OVER w, lag(turn, 1) OVER w, lead(turn, 1) OVER w, lead(turn, 2) OVER w], lambda x: x IS NOT NULL), ',') AS neighbours FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def neighbours_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns before and after each."""
    rows = U.neighbours(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "turn", 2)
    return rows.select("conv_id", "turn", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


_SPECIFIC = ["What does Example 9 say?", "In the Ann and Bob example, who pays?", "What is on line 4 of the worksheet?", "What amount does she enter?", "What figure goes there?", "What is the limit?", "EXAMPLE 3"]


@query("WITH g AS (SELECT item_id, text AS question FROM benchmark UNION ALL SELECT -n, t FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(_SPECIFIC, 1)) + f") v(n, t)) SELECT item_id FROM g WHERE item_id % 2 <> 0 AND NOT regexp_matches(coalesce(question, ''), {_q('|'.join(T.SPECIFIC))})")
def general_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that aren't about one example; every second entry has no passage to find."""
    own = spark.createDataFrame([(-i, t) for i, t in enumerate(_SPECIFIC, 1)], "item_id long, question string")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("question")).unionByName(own)
    return U.general_gold(rows.withColumn("gold_chunk_ids", F.when(F.col("item_id") % 2 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))).select("item_id")


@query("WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN source END AS pub, CASE WHEN doc_id % 5 > 0 THEN lang END AS level FROM documents) SELECT pub AS expected_pub, level AS difficulty, grouping(pub) = 1 AS all_pubs, grouping(level) = 1 AS all_difficulties, count(*) AS n, count(l.doc_id) AS verified FROM e LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY GROUPING SETS ((), (pub), (level))")
def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some entries have no publication or no difficulty; totals are told from those."""
    flagged = table(spark, sf_dir, "labels").select("doc_id", F.lit("x").alias("verified_by")).distinct()
    rows = table(spark, sf_dir, "documents").join(flagged, "doc_id", "left")
    return U.gold_counts(rows.select(F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("expected_pub"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("difficulty"), "verified_by"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules."""
    level = F.when(F.col("p_size") > 40, "ERROR").when(F.col("p_size") > 20, "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("field_path"), F.col("p_type").alias("form_family"), level.alias("severity"), (2020 + F.col("p_partkey") % 3).cast("int").alias("tax_year"))


_RULES = "r AS (SELECT p_partkey AS rule_id, p_brand AS field_path, p_type AS form_family, CASE WHEN p_size > 40 THEN 'ERROR' WHEN p_size > 20 THEN 'WARNING' ELSE 'INFO' END AS severity, (2020 + p_partkey % 3)::INT AS tax_year FROM part)"


@query(f"WITH {_RULES} SELECT * FROM r WHERE field_path = 'Brand#11' AND tax_year = 2021 AND severity = 'ERROR' UNION ALL SELECT * FROM r WHERE field_path = 'Brand#22'")
def rules_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    return U.rules_by_field(rules, "Brand#11", 2021, "ERROR").unionByName(U.rules_by_field(rules, "Brand#22"))


@query(f"WITH {_RULES} SELECT rule_id, severity FROM r WHERE form_family = (SELECT min(form_family) FROM r) AND tax_year = 2020")
def rules_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    return U.rules_by_form(rules, rules.agg(F.min("form_family")).first()[0], 2020).select("rule_id", "severity")


@query("SELECT doc_id, source, n_chars, round(avg(n_chars) OVER (PARTITION BY source), 4) AS mean_tokens FROM documents WHERE source IS NOT NULL")
def chunk_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the mean of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pub"), F.col("n_chars").alias("token_count"))
    return U.chunk_averages(docs).select("doc_id", F.col("pub").alias("source"), F.col("token_count").alias("n_chars"), F.round("mean_tokens", 4).alias("mean_tokens"))


@query("SELECT count(*) AS chunks, count(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, '')) AS annotated, count(*) FILTER (n_chars > 1000) AS with_lines, count(l.doc_id) AS embedded FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def annotated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("embedding")).distinct()
    lines = F.when(F.col("n_chars") > 1000, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").join(flagged, "doc_id", "left").select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("context_annotation"), lines.alias("line_refs"), "embedding")
    return U.annotated(rows)


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS value FROM part")
def distinct_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.distinct_values(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("words")), "words")


_PUBS = [("17", "individual", 1, "income,filing", "2022,2023,2024"), ("501", "individual", 1, "Dependents", "2024"), ("15-B", "business", 2, "fringe", "2023"), ("590a", "retirement", 1, "ira,Income limits", "2022,2025"), ("9", "retirement", 3, "", ""), ("x", "business", 3, "income", "2025")]
_PUB_SQL = "p AS (SELECT pub, category, tier, string_split(tags, ',') AS tags, list_filter(string_split(years, ','), lambda y: y <> '') AS years FROM (VALUES " + ", ".join(str(p) for p in _PUBS) + ") v(pub, category, tier, tags, years))"


def _pubs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_PUBS, "pub string, category string, tier int, tags string, years string")
    return rows.select("pub", "category", "tier", F.split("tags", ",").alias("topic_tags"), F.filter(F.split("years", ","), lambda y: y != "").cast("array<int>").alias("tax_years"))


_SOURCES = "p AS (SELECT source AS pub, min(lang) AS category, (count(*) % 3 + 1)::INT AS tier, list_sort(list(DISTINCT upper(lang))) AS tags, list_sort(list(DISTINCT 2020 + doc_id % 97 % 6)) AS years FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents as publications: their languages as topics, their numbers as years."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    sets = (F.sort_array(F.collect_set(F.upper("lang"))).alias("topic_tags"), F.sort_array(F.collect_set((2020 + F.col("doc_id") % 97 % 6).cast("int"))).alias("tax_years"))  # four languages, six years
    return docs.groupBy(F.col("source").alias("pub")).agg(F.min("lang").alias("category"), (F.count("*") % 3 + 1).cast("int").alias("tier"), *sets)


@query(f"WITH {_SOURCES} SELECT pub, 'topic' AS why FROM p WHERE len(list_filter(tags, lambda t: contains(lower(t), 'e'))) > 0 UNION ALL SELECT pub, 'tier' FROM p WHERE tier = 1 AND category = 'de' UNION ALL SELECT pub, 'year' FROM p WHERE list_contains(years, 2025)")
def registry_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry by topic, by tier and category, and by year."""
    pubs = _sources(spark, sf_dir)
    named = lambda d, n: d.select("pub", F.lit(n).alias("why"))
    return named(U.registry(pubs, topic="E"), "topic").unionByName(named(U.registry(pubs, category="de", tier=1), "tier")).unionByName(named(U.registry(pubs, year=2025), "year"))


@query(f"WITH {_PUB_SQL}, l AS (SELECT pub, list_max(years)::INT AS year FROM p WHERE len(years) > 0) SELECT l.pub, l.year FROM l WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src' || left(l.pub, 1) AND 2020 + doc_id % 3 + 2 = l.year)")
def ingest_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest year of each publication, where no document has it."""
    there = table(spark, sf_dir, "documents").select("source", (2022 + F.col("doc_id") % 3).cast("int").alias("year")).distinct()
    pubs = _pubs(spark)
    present = pubs.select("pub", F.concat(F.lit("src"), F.left("pub", F.lit(1))).alias("source")).join(there, "source").select("pub", "year")
    return U.latest_missing(pubs, present)


@query(f"WITH {_SOURCES} SELECT pub, tier, list_contains(years, 2024) AS y2024, list_contains(years, 2025) AS y2025, row_number() OVER (ORDER BY tier, coalesce(try_cast(regexp_replace(pub, '[^0-9]', '', 'g') AS BIGINT), 0), pub) AS place FROM p")
def year_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which years each source has, by tier and number."""
    from pyspark.sql import Window

    from lodestrata.functions.questions import natural

    return U.year_matrix(_sources(spark, sf_dir), [2024, 2025]).withColumn("place", F.row_number().over(Window.orderBy("tier", *natural("pub"))))  # one row a publication


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal >= 0) AS good, count(*) FILTER (NOT coalesce(c_acctbal >= 0, false)) AS rejected, round(count(*) FILTER (c_acctbal >= 0) / count(*), 6) AS success_rate FROM customer")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.parse_summary(relations.split_rejects(table(spark, sf_dir, "customer"), {"negative balance": F.col("c_acctbal") >= 0}))


@query("WITH n AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0), o AS (SELECT * FROM orders WHERE o_orderkey % 17 <> 0) SELECT CASE WHEN o.o_orderkey IS NULL THEN 'ADDED' WHEN n.o_orderkey IS NULL THEN 'REMOVED' END AS change_type, count(*) AS n FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL GROUP BY 1")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return relations.changes(relations.version_diff(orders.filter("o_orderkey % 17 <> 0"), orders.filter("o_orderkey % 13 <> 0"), "o_orderkey", ["o_orderstatus"]))


@query("WITH d AS (SELECT o_orderkey, 'X' || max(l_linenumber) AS o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY o_orderkey), b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0) SELECT b.o_orderkey, coalesce(d.o_orderstatus, b.o_orderstatus) AS o_orderstatus, b.o_orderpriority FROM b LEFT JOIN d USING (o_orderkey) UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM d WHERE o_orderkey % 5 = 0")
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta with several rows a key, of which the last counts, changes one column; new keys have null in the others."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("X"), F.col("l_linenumber").cast("string")).alias("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return relations.upsert(orders.filter("o_orderkey % 5 <> 0"), lines, ["o_orderkey"], ["o_orderstatus"], F.substr("o_orderstatus", F.lit(2)).cast("int"))


@query("SELECT p_partkey AS rule_id, s.n AS form_title FROM part LEFT JOIN (SELECT DISTINCT p_type AS f, 2020 AS y, upper(p_type) AS n FROM part) s ON s.f = p_type AND s.y = 2020 + p_partkey % 3 WHERE p_size > 25")
def current_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rules with the title of their form in one of three years."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("form_type"), (2020 + F.col("p_partkey") % 3).alias("tax_year"), (F.col("p_size") > 25).alias("is_current"))
    forms = table(spark, sf_dir, "part").select(F.col("p_type").alias("form_type"), F.lit(2020).cast("long").alias("tax_year"), F.upper("p_type").alias("title")).distinct()
    return U.current_rules(rules, forms).select("rule_id", "form_title")


@query("SELECT event_type AS step, count(*) AS runs, count(*) FILTER (value > 50) AS passed, max_by(value, (ts, event_id)) AS last_rate FROM events GROUP BY event_type")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of a step."""
    return U.latest_runs(table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), (F.col("value") > 50).alias("passed"), F.col("value").alias("pass_rate"), F.struct("ts", "event_id").alias("run_at")))


@query("SELECT d.doc_id AS section_id, d.lang AS form_type, left(d.text, 30) AS preview FROM documents d WHERE d.doc_id % 2 = 0 AND d.lang IS NOT NULL")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = docs.select(F.col("lang").alias("page_id"), F.col("doc_id").alias("section_id"), F.when(F.col("doc_id") % 2 == 0, "1").alias("line"), F.lit("h").alias("heading"), "text")
    pages = docs.select(F.col("lang").alias("page_id"), F.col("lang").alias("form_type"), F.lit(2024).alias("tax_year")).distinct()
    return U.line_sections(parts, pages, 30).select("section_id", "form_type", "preview")


@query("SELECT conv_id AS qid, role AS retrieval_method, count(*) AS n FROM conversations GROUP BY ALL")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.method_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("role").alias("retrieval_method")))


@query(f"WITH {_LEX}, {_GROUPED}, c AS (SELECT qid, id, source AS pub, score, coalesce(text, '') AS text FROM a JOIN documents ON doc_id = id), r AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, count(*) OVER (PARTITION BY qid, pub) AS p, row_number() OVER (PARTITION BY qid, pub ORDER BY score DESC, id) AS k FROM c), j AS (SELECT qid, pub, string_agg(text, chr(10) || chr(10) ORDER BY k) AS t FROM r WHERE n >= 8 AND p > 1 GROUP BY ALL) SELECT qid, id, pub, t AS text FROM r JOIN j USING (qid, pub) WHERE k = 1 UNION ALL SELECT qid, id, pub, text FROM r WHERE NOT (n >= 8 AND p > 1)".replace("FROM a JOIN documents", "FROM l1 JOIN documents"))
def compressed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten best documents of each passage those of one source become one, with their whole texts from the best on."""
    main, _, docs = _lists(spark, sf_dir)
    rows = small(main.select("qid", "id", "score")).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("pub"), F.coalesce("text", F.lit("")).alias("text")), "id")
    return U.compressed(stored(rows), lambda t: t).select("qid", "id", "pub", "text")  # so that the documents are read once, and the texts of the best alone go on
