"""Queries: classification, references, sections, chunks and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import classify
from lodestrata.operators import chunking
from lodestrata.operators import sections as S

from .registry import query, table

_q = lambda s: "'" + s.replace("'", "''") + "'"
_QUESTIONS = ["Which line do I report wages on?", "What triggers error code F1040-041?", "Standard or itemized deduction", "How much is the limit?", "My client sold a house", "Hello", ""]
_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN {_q(n)}" for n, p, _ in classify.INTENTS) + " ELSE 'general' END"


@query(f"SELECT intent, count(*) AS n FROM (SELECT {_INTENT_SQL} AS intent FROM (SELECT lower(text) AS t FROM conversations WHERE role = 'user' UNION ALL SELECT lower(x) FROM (VALUES {', '.join(f'({_q(x)})' for x in _QUESTIONS)}) v(x))) GROUP BY intent")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("text").unionByName(spark.createDataFrame([(x,) for x in _QUESTIONS], "text string"))
    return asked.groupBy(classify.intent(F.col("text")).intent.alias("intent")).agg(F.count("*").alias("n"))


_HEADINGS = [("What's New", ""), ("Reminders", ""), ("Line 1a", "Income"), ("Wages", "Line Instructions"), ("Filing Status", ""), ("Paid Preparer", ""), ("Sign Your Return", ""), ("Schedule C Requirement", ""), ("Other", "")]
_SECTION_SQL = "CASE " + " ".join("WHEN " + {"own": "regexp_matches(h, {0})", "above": "regexp_matches(a, {0})", "both": "regexp_matches(a, {0}) OR regexp_matches(h, {0})"}[w].format(_q(p)) + f" THEN {_q(n)}" for n, p, w in classify.SECTIONS) + " ELSE 'GENERAL' END"


@query(f"WITH v(h, a) AS (VALUES {', '.join(f'({_q(h)}, {_q(a)})' for h, a in _HEADINGS)} UNION ALL SELECT left(coalesce(text, ''), 60), coalesce(role, '') FROM conversations) SELECT {_SECTION_SQL} AS section_type, count(*) AS n, min(h) AS first FROM v GROUP BY 1")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as headings, and headings of every type."""
    turns = table(spark, sf_dir, "conversations").select(F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("h"), F.coalesce("role", F.lit("")).alias("a"))
    rows = spark.createDataFrame(_HEADINGS, "h string, a string").unionByName(turns)
    return rows.groupBy(classify.section_type(F.col("h"), F.col("a")).alias("section_type")).agg(F.count("*").alias("n"), F.min("h").alias("first"))


_REFS = [(1, "See Form 1040 and Schedule C, line 12a; Form W-2 and form 1040 again."), (2, "Pub. 596 and Publication. 17, lines 3"), (3, "nothing")]
_REF_SQL = ", ".join(f"array_to_string(list_distinct_ordered(regexp_extract_all(t, {_q(p)}, 1)), ',') AS {n}" for n, p in classify.REFERENCES.items()).replace("list_distinct_ordered(", "(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(r) AS x, generate_subscripts(r, 1) AS i FROM (SELECT ").replace(", 1)), ','", ", 1) AS r)) GROUP BY x)), ','")


@query(f"SELECT id, {', '.join(f'coalesce({p.rsplit(' AS ', 1)[0]}, {_q('')}) AS {p.rsplit(' AS ', 1)[1]}' for p in _REF_SQL.split(', array_to_string(') for p in [p if p.startswith('array_to_string(') else 'array_to_string(' + p])} FROM (VALUES {', '.join(f'({i}, {_q(t)})' for i, t in _REFS)} UNION ALL SELECT doc_id, coalesce(text, '') FROM documents) v(id, t)")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(_REFS, "id long, t string").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return texts.select("id", *(F.array_join(c, ",").alias(n) for n, c in classify.references(F.col("t")).items()))


_STRIP = lambda c: f"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '[\\s]+', ' ', 'g'))"
_CLEAN = "html"
for _tag in S.SKIPPED:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b.*?</{_tag}>', '', 'g')"


@query(f"WITH p AS (SELECT page_id, unnest(string_split(c, chr(1))) AS part, generate_subscripts(string_split(c, chr(1)), 1) - 1 AS sequence FROM (SELECT page_id, regexp_replace({_CLEAN}, '(?i)(<(?:h1|h2)\\b)', chr(1) || '\\1', 'g') AS c FROM pages)), s AS (SELECT page_id, sequence, lower(regexp_extract(part, '(?is)^<(h1|h2)\\b[^>]*>(.*?)</(?:h1|h2)>', 1)) AS level, {_STRIP('''regexp_extract(part, '(?is)^<(h1|h2)\\b[^>]*>(.*?)</(?:h1|h2)>', 2)''')} AS heading, array_to_string(list_filter(list_transform(regexp_extract_all(part, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_STRIP('x')}), lambda x: x <> ''), ' ') AS text FROM p) SELECT page_id, sequence, level, heading, text FROM s WHERE sequence > 0 OR text <> ''")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(table(spark, sf_dir, "pages"), "page_id", "html", ("h1", "h2")).select("page_id", "sequence", "level", "heading", "text")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs; a test holds every chunk against a plain walk over the whole table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunks("text", "\n")).alias("chunk", "c"))
    return docs.select("doc_id", "chunk", "c.tokens", F.sha2("c.text", 256).alias("text_hash"))


@query("WITH o AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT source, string_agg(lang, ',' ORDER BY first) AS langs FROM o GROUP BY source")
def first_seen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each source in the order in which they first occur; two small aggregations instead of a list of all rows."""
    first = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "lang"))), lambda x: x.lang), ",").alias("langs"))


@query("WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i FROM conversations) SELECT conv_id, (i // greatest(2, n // 6))::BIGINT AS part, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM p GROUP BY 1, 2")
def range_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation in at most about six ranges of equal size."""
    w = Window.partitionBy("conv_id")
    placed = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("turn", "role")) - 1).alias("i"))
    return placed.groupBy("conv_id", F.expr("i DIV greatest(2, n DIV 6)").alias("part")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


_RULE_TEXTS = ["the limit is here", "must be attached", "plain", "a threshold", "HSA and 401k", "total must equal", "see Form 8960", "requires Schedule D", "sum of all"]
_CATEGORY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, {_q(k.lower())})" for k in keys) + f" THEN {_q(n)}" for n, keys in classify.CATEGORIES) + " ELSE 'other' END"


@query(f"WITH r AS (SELECT lower(coalesce(text, '')) || ' ' AS t FROM documents UNION ALL SELECT lower(x) || ' ' FROM (VALUES {', '.join(f'({_q(x)})' for x in _RULE_TEXTS)}) v(x)) SELECT {_CATEGORY_SQL} AS category, count(*) AS n FROM r GROUP BY 1")
def rule_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of rules, and texts of every category."""
    rows = spark.createDataFrame([(x,) for x in _RULE_TEXTS], "t string").unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("t")))
    return rows.groupBy(classify.rule_category(F.col("t"), F.lit("")).alias("category")).agg(F.count("*").alias("n"))
