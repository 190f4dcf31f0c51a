"""Queries: headings, chapters, chunks, sections, summaries and context lines of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import texts as T
from lodestrata.operators import documents as D
from lodestrata.operators import sections as S

from .registry import query, table
from .text import _CLEAN, _STRIP

_q = lambda s: "'" + s.replace("'", "''") + "'"
_TEXT = "coalesce(text, '')"


@query(f"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_TEXT}, '\\n{{2,}}'), lambda x: trim(replace(x, chr(10), ' '))), lambda x: length(x) > 10) AS p FROM documents) SELECT doc_id, len(p) AS n, sha256(array_to_string(p, chr(10))) AS text_hash FROM p")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.paragraphs(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n"), F.sha2(F.array_join(parts, "\n"), 256).alias("text_hash"))


@query(f"SELECT doc_id, len(regexp_extract_all(regexp_replace({_TEXT}, '\\s+$', ''), '[.!?]\\s+')) + 1 + CASE WHEN regexp_matches({_TEXT}, '[.!?]\\s+$') THEN 1 ELSE 0 END AS n FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


_LINES = ["Chapter 5. Income and Gains 47", "47 Chapter 5 Income", "PART II NOTES", "Part 2 Wages", "GENERAL RULES", "Standard Deduction", "92 Standard Deduction 12", "this is plain", "It ends here.", "Short", "", "123 456 789", "Chapter one is short"]
_UPPER = "(upper(t) = t AND lower(t) <> t)"
_CLEAN_LINE = "trim(regexp_replace({0}, '\\s+\\d{{1,4}}\\s*$', ''))"
_BARE = _CLEAN_LINE.format("regexp_replace(t, '^\\d+\\s+', '')")
_TITLED = "array_to_string(list_transform(string_split(t, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') = t"
_HEADING = f"""CASE WHEN t = '' OR length(t) > 120 OR regexp_matches(t, {_q(T.CONTENTS)}) THEN [NULL, NULL] WHEN regexp_matches(t, {_q(T.CHAPTER)}) THEN [{_CLEAN_LINE.format('t')}, NULL] WHEN {_UPPER} AND length(t) BETWEEN 6 AND 60 THEN [t, NULL]
 WHEN (({_TITLED} AND lower(t) <> upper(t)) OR (upper(left(t, 1)) = left(t, 1) AND lower(left(t, 1)) <> left(t, 1) AND NOT contains('.?!,;:', right(t, 1)))) AND length(t) BETWEEN 6 AND 60 AND contains(t, ' ') AND length({_BARE}) BETWEEN 6 AND 60 AND contains({_BARE}, ' ') THEN [NULL, {_BARE}] ELSE [NULL, NULL] END"""


@query(f"WITH l AS (SELECT -n AS id, trim(t) AS t FROM (VALUES {', '.join(f'({i}, {_q(t)})' for i, t in enumerate(_LINES, 1))}) v(n, t) UNION ALL SELECT doc_id, trim(unnest(string_split({_TEXT}, chr(10)))) FROM documents), h AS (SELECT id, {_HEADING} AS h FROM l) SELECT id, count(h[1]) AS chapters, count(h[2]) AS sections, coalesce(min(h[1]), '') AS chapter, coalesce(min(h[2]), '') AS section FROM h GROUP BY id")
def heading_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, t) for i, t in enumerate(_LINES, 1)], "id long, t string")
    rows = own.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t")))
    found = rows.select("id", T.heading(F.col("t")).alias("h"))
    return found.groupBy("id").agg(F.count("h.chapter").alias("chapters"), F.count("h.section").alias("sections"), F.coalesce(F.min("h.chapter"), F.lit("")).alias("chapter"), F.coalesce(F.min("h.section"), F.lit("")).alias("section"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as publications and their turns as pages; every third turn has the header of a chapter, every fourth a section above its text."""
    t = F.col("turn")
    head = F.when(t % 3 == 0, F.concat(F.lit("Publication 17 (2024) Chapter "), (1 + (t / 3).cast("int")).cast("string"), F.lit(" Gains and Losses 7\nChapter "), (1 + (t / 3).cast("int")).cast("string"), F.lit(" Gains\n"))).otherwise("")
    sub = F.when(t % 4 == 1, "Some Rules Apply\n").otherwise("")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("x")).select(F.col("conv_id").alias("doc_id"), (t + 1).alias("page_num"), F.concat(head, sub, F.lower("x"), F.lit(" .")).alias("text"))


@query("WITH p AS (SELECT DISTINCT conv_id, turn, 1 + turn // 3 AS number FROM conversations WHERE turn % 3 = 0) SELECT conv_id AS doc_id, number::INT AS number, 'Chapter ' || number || '. Gains and Losses' AS title, min(turn) + 1 AS first_page, max(turn) + 1 AS last_page FROM p GROUP BY conv_id, number")
def chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chapter_ranges(_paged(spark, sf_dir))


@query("WITH b AS (SELECT p_partkey, p_brand, p_size FROM part), r(lo, hi, o, band) AS (VALUES (1, 10, 1, 'small'), (8, 25, 2, 'medium'), (20, 50, 3, 'large')), k AS (SELECT DISTINCT p_brand FROM part WHERE p_brand > 'Brand#2') SELECT p_partkey, arg_min(band, o) AS band FROM b LEFT JOIN k ON k.p_brand = b.p_brand LEFT JOIN r ON k.p_brand IS NOT NULL AND p_size BETWEEN lo AND hi GROUP BY p_partkey")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of some overlapping ranges of their own brand that sizes are in."""
    part = table(spark, sf_dir, "part")
    bands = spark.createDataFrame([(1, 10, 1, "small"), (8, 25, 2, "medium"), (20, 50, 3, "large")], "lo int, hi int, o int, band string")
    ranges = part.filter("p_brand > 'Brand#2'").select("p_brand").distinct().crossJoin(F.broadcast(bands))  # three rows
    return D.first_range(part.select("p_partkey", "p_brand", "p_size"), ranges, "p_brand", "p_size", "lo", "hi", "o", "band").select("p_partkey", "band")


@query()
def document_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to chunks under their headings; a test holds it against a plain walk."""
    return D.walk(_paged(spark, sf_dir)).select("doc_id", "chunk_index", "chapter", "section", "page_start", "page_end", "token_count", F.sha2("text", 256).alias("text_hash"))


@query("WITH c AS (SELECT source, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT source, (i // CASE WHEN n > 30 THEN greatest(20, n // 6) ELSE n END)::BIGINT AS part, min(n_chars) AS first_page, max(n_chars) AS last_page, count(*) AS n FROM c GROUP BY 1, 2")
def inferred_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.inferred_chapters(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars")


@query(f"WITH t AS (SELECT doc_id, coalesce(text, '') || ' The limit is $6,500 or 7.5% of $1; cap of 40.' AS t FROM documents), k AS (SELECT doc_id, regexp_extract_all(t, {_q(T.THRESHOLD)}) AS a FROM t), u AS (SELECT doc_id, unnest(list_concat(list_filter(a, lambda x: length(x) > 2), ['Form1'])) AS x, generate_subscripts(list_concat(list_filter(a, lambda x: length(x) > 2), ['Form1']), 1) AS i FROM k), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, string_agg(x, '|' ORDER BY n) AS terms FROM r WHERE n <= 20 GROUP BY doc_id")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" The limit is $6,500 or 7.5% of $1; cap of 40."))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.key_terms(text, F.array(F.lit("Form1"))), "|").alias("terms"))


@query("""SELECT doc_id, CASE source WHEN 'src0' THEN CASE WHEN regexp_matches(coalesce(text, ''), '(?i)a') AND (contains(lower(coalesce(text, '')), 'e') OR contains(lower(coalesce(text, '')), 'zz')) THEN concat_ws(' ', '[Ref]', CASE WHEN contains(lower(coalesce(text, '')), 'e') THEN 'has e.' END, CASE WHEN contains(lower(coalesce(text, '')), 'zz') THEN 'has zz.' END) END
 WHEN 'src1' THEN CASE WHEN regexp_matches(coalesce(text, ''), '(?i)q') THEN concat_ws(' | ', '[Q]', CASE WHEN contains(lower(coalesce(text, '')), 'u') THEN 'u' END) END ELSE concat_ws(' | ', '[Pub ' || source || '] ' || nullif(lang, ''), 'Related forms: Form1') END AS line FROM documents""")
def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a registry with two entries, and the general line of other sources."""
    e = T.Enrichment()
    e.register("src0", "a", "[Ref]", [("e", "has e."), ("zz", "has zz.")])
    e.register("src1", "q", "[Q]", [("u", "u")], " | ", always=True)
    return table(spark, sf_dir, "documents").select("doc_id", e.line(F.col("source"), F.col("text"), F.col("lang"), F.lit(""), F.array(F.lit("Form1"))).alias("line"))


@query(f"WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' $5 and $1,200.50' ELSE '' END AS t FROM documents), a AS (SELECT *, regexp_extract_all(t, {_q(T.AMOUNT)})[1:5] AS m FROM t) SELECT doc_id, concat_ws(' ', 'This chunk from Pub ' || source || ' (T)', 'chapter ''' || nullif(lang, '') || '''', 'for tax year 2024', CASE WHEN len(m) > 0 THEN '— mentions amounts: ' || array_to_string(m, ', ') END) || '.' AS annotation FROM a WHERE source IS NOT NULL")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " $5 and $1,200.50").otherwise(""))
    return docs.select("doc_id", T.annotation("Pub", F.col("source"), F.lit("T"), F.col("lang"), F.lit(""), F.lit(2024), text).alias("annotation"))


@query("WITH f AS (SELECT doc_id, lower(coalesce(text, '')) AS t, ['The', 'ou', 'zzz'] AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: t <> '' AND contains(t, lower(x)))) AS found, round(len(list_filter(w, lambda x: t <> '' AND contains(t, lower(x)))) / 3, 3) AS ratio, array_to_string(list_filter(w, lambda x: NOT (t <> '' AND contains(t, lower(x)))), ',') AS missing FROM f")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", T.facts(F.col("text"), F.array(F.lit("The"), F.lit("ou"), F.lit("zzz"))).alias("f"))
    return made.select("doc_id", "f.found", "f.ratio", F.array_join("f.missing", ",").alias("missing"))


@query("WITH s AS (SELECT doc_id, greatest(0, least(4, n_chars % 7 - 1)) AS a, greatest(0, least(4, n_chars % 5)) AS b FROM documents) SELECT doc_id, a::INT AS a, b::INT AS b, (a + b) / 2.0 >= 3 AND (a >= 3)::INT + (b >= 3)::INT >= 2 AS passed FROM s")
def score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = T.clamped(F.col("n_chars") % 7 - 1), T.clamped(F.col("n_chars") % 5)
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"), T.passes((a + b) / 2, [a, b]).alias("passed"))


@query("WITH r AS (SELECT item_id, unnest([1, 2]) AS k FROM benchmark) SELECT item_id, count(*) AS n, CASE WHEN item_id % 3 = 0 THEN 'complex' ELSE 'medium' END AS difficulty FROM r WHERE item_id % 4 <> 3 AND NOT (k = 2 AND item_id % 4 = 2) GROUP BY item_id")
def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers out of texts with JSON in a code block, under a name, alone, and with none."""
    item = F.struct(F.lit("What is asked of this passage?").alias("question"), F.lit("An answer that is long enough.").alias("ground_truth"), F.when(F.col("item_id") % 3 == 0, "complex").otherwise("odd").alias("difficulty"))
    both, one = F.to_json(F.array(item, item)), F.to_json(item)
    kind = F.col("item_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: {\"qa\": "), both, F.lit("}"))).when(kind == 2, one).otherwise("sorry, none {")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.pairs_in(text, F.lit("medium"))).alias("p"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.max("p.difficulty").alias("difficulty"))


@query(f"SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?i)<title>([^<]+)</title>', 1)) AS title, sha256(coalesce(html, '')) AS html_hash FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.titles(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first headings are taken for major sections; tests hold each rule against sections made by hand."""
    html = F.regexp_replace("html", r"(?i)<(/?)h1\b", "<$1h2")
    return S.sections_by_role(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html").withColumn("texts", F.array_join("texts", "\n"))


_FIELDS = [("1", "Wages"), ("2", "Interest"), ("2", "Dividends"), ("3b", "Gains")]
_SECTIONS = f"p AS (SELECT page_id, unnest(string_split(c, chr(1))) AS part, generate_subscripts(string_split(c, chr(1)), 1) - 1 AS sequence FROM (SELECT page_id, regexp_replace({_CLEAN}, '(?i)(<(?:h1|h2)\\b)', chr(1) || '\\1', 'g') AS c FROM pages)), s AS (SELECT page_id, sequence, 'Lines ' || (sequence + page_id % 2) || 'a–' || sequence || ' ' || {_STRIP('''regexp_extract(part, '(?is)^<(h1|h2)\\b[^>]*>(.*?)</(?:h1|h2)>', 2)''')} AS heading FROM p WHERE sequence > 0)"


@query(f"WITH {_SECTIONS}, l AS (SELECT page_id, sequence, heading, CASE WHEN sequence IN (1, 2) THEN sequence::VARCHAR ELSE (sequence + page_id % 2) || 'a' END AS line FROM s), f(line, field) AS (VALUES {', '.join(str(f) for f in _FIELDS)}) SELECT page_id, sequence, page_id || '::' || replace(left(heading, 40), ' ', '_') AS section_id, 'LINE_INSTRUCTION' AS section_type, line, coalesce((SELECT string_agg(field, ',' ORDER BY field) FROM f WHERE f.line = l.line), '') AS fields FROM l")
def assembled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of web pages as headings of lines, joined to the fields of a small table."""
    parts = S.sections(table(spark, sf_dir, "pages"), "page_id", "html", ("h1", "h2")).filter("sequence > 0")
    named = parts.withColumns({"heading": F.concat(F.lit("Lines "), (F.col("sequence") + F.col("page_id") % 2).cast("string"), F.lit("a–"), F.col("sequence").cast("string"), F.lit(" "), F.col("heading")), "anchor": F.lit("")})
    fields = spark.createDataFrame(_FIELDS, "line string, field string")
    made = D.assembled(named, "page_id", fields, "h1")
    return made.select("page_id", "sequence", "section_id", "section_type", "line", F.array_join("field_names", ",").alias("fields"))


@query("WITH r AS (SELECT doc_id, 'Form' || (doc_id % 3) AS ref FROM documents), a AS (SELECT 'Form1' AS alias, 'IRS1' AS form) SELECT lang AS src, 's' || doc_id AS dst, 'HAS_SECTION' AS type FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 's' || doc_id, source, 'EXPLAINS' FROM documents WHERE source IS NOT NULL UNION ALL SELECT 's' || doc_id, coalesce(form, ref), 'REFERENCES_FORM' FROM r LEFT JOIN a ON alias = ref")
def section_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast("array<string>"))
    parts = docs.select(F.col("lang").alias("page_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("section_id"), fields.alias("field_names"), F.array(F.concat(F.lit("Form"), (F.col("doc_id") % 3).cast("string"))).alias("cross_refs"))
    return D.section_edges(parts, "page_id", spark.createDataFrame([("Form1", "IRS1")], "alias string, form string"))


@query("""WITH c AS (SELECT source AS pub, lang AS chapter, min(doc_id) AS seen FROM documents WHERE source IS NOT NULL AND lang <> '' GROUP BY ALL), s AS (SELECT source AS pub, coalesce(lang, '(General)') AS chapter, 'S' || (doc_id % 4) AS section, min(doc_id) AS seen FROM documents WHERE source IS NOT NULL GROUP BY ALL),
l AS (SELECT c.pub, c.seen, '  - ' || c.chapter || coalesce(chr(10) || (SELECT string_agg('    - ' || section, chr(10) ORDER BY s.seen) FROM s WHERE s.pub = c.pub AND s.chapter = c.chapter), '') AS t FROM c)
SELECT pub, 'p' || pub || '-2024::summary' AS chunk_id, '[PUBLICATION SUMMARY] Publication ' || pub || ': T (Tax Year 2024)' || chr(10) || 'This publication covers the following topics:' || chr(10) || string_agg(t, chr(10) ORDER BY seen) || chr(10) || 'Key forms and schedules: Form1' AS text FROM l GROUP BY pub""")
def publication_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor for each source from its languages as chapters."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    chunks = docs.select(F.col("source").alias("pub"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("chapter"), F.concat(F.lit("S"), (F.col("doc_id") % 4).cast("string")).alias("section"), F.array(F.lit("Form1")).alias("form_refs"))
    titles = docs.select(F.col("source").alias("pub")).distinct().select("pub", F.lit(2024).alias("year"), F.lit("T").alias("title"))
    return D.summaries(chunks, titles).select("pub", "chunk_id", "text")


@query("""WITH d AS (SELECT source AS pub, coalesce(nullif(lang, ''), '(General)') AS chapter, doc_id, 'The limit is $' || (doc_id % 7) || '00 here. ' || coalesce(text, '') AS text, 'Form' || (doc_id % 11) AS form FROM documents WHERE source IS NOT NULL), g AS (SELECT pub, chapter, count(*) AS n, min(doc_id) AS first FROM d GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pub, chapter ORDER BY doc_id) AS k FROM d), w AS (SELECT pub, chapter, list_filter(regexp_split_to_array(trim(arg_min(text, k)), '\\s+'), lambda x: x <> '') AS w FROM o WHERE k <= 3 AND length(text) > 100 GROUP BY ALL),
f AS (SELECT pub, chapter, string_agg(form, ', ' ORDER BY form) AS forms FROM (SELECT *, row_number() OVER (PARTITION BY pub, chapter ORDER BY form) AS r FROM (SELECT DISTINCT pub, chapter, form FROM d)) WHERE r <= 8 GROUP BY ALL)
SELECT g.pub, g.chapter, format('p{}-2024::section_summary::{:04d}', g.pub, row_number() OVER (PARTITION BY g.pub ORDER BY first, g.chapter) - 1) AS chunk_id, '[SECTION SUMMARY] Publication ' || g.pub || ' (Tax Year 2024), ' || g.chapter AS head, coalesce(array_to_string(w.w[1:150], ' ') || CASE WHEN len(w.w) > 150 THEN '...' ELSE '' END, '') AS passage, forms FROM g LEFT JOIN w USING (pub, chapter) LEFT JOIN f USING (pub, chapter) WHERE g.chapter <> '(General)' OR n >= 3""")
def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor for each language of a source, with room for all its parts, taken apart again into its lines."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    text = F.concat(F.lit("The limit is $"), (F.col("doc_id") % 7).cast("string"), F.lit("00 here. "), F.coalesce("text", F.lit("")))
    form = F.array(F.concat(F.lit("Form"), (F.col("doc_id") % 11).cast("string")))
    chunks = docs.select(F.col("source").alias("pub"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("chapter"), F.lit("S").alias("section"), text.alias("text"), form.alias("form_refs"))
    years = docs.select(F.col("source").alias("pub")).distinct().withColumn("year", F.lit(2024))
    lines = F.split("text", "\n")
    passage = F.coalesce(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("The limit is"))), F.lit(0)), F.lit(""))
    forms = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("Forms: "))), F.lit(0))
    return D.chapter_summaries(chunks, years, tokens=100_000).select("pub", "chapter", "chunk_id", F.get(lines, F.lit(0)).alias("head"), passage.alias("passage"), F.substr(forms, F.lit(8)).alias("forms"))


@query()
def chapters_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents without chapters, a few of which name one in their texts, placed in chapters by page; a test holds it against a plain walk over the table."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    named = F.when((F.col("doc_id") % 9 == 4) & (F.crc32("source") % 2 == 0), F.concat(F.lit("Chapter "), (1 + F.col("doc_id") % 5).cast("string"), F.lit(". Gains and Losses\n"))).otherwise("")
    page = (F.col("doc_id") / 3).cast("int")
    chunks = docs.select(F.col("source").alias("pub"), F.col("doc_id").alias("chunk_index"), page.alias("page_start"), (page + 1).alias("page_end"), F.concat(named, F.lower(F.coalesce("text", F.lit("")))).alias("text"), F.lit("").alias("chapter"))
    return D.with_chapters(chunks).select("pub", "chunk_index", "page_start", "chapter")


@query("WITH t(topic, pub, c) AS (VALUES ('a', 'src0', 'EN'), ('b', 'src0', ''), ('c', 'src1', 'x en y'), ('d', 'src1', 'zz')) SELECT DISTINCT source AS pub, lang AS chapter, topic FROM documents JOIN t ON pub = source AND (contains(lower(coalesce(lang, '')), lower(c)) OR contains(lower(c), lower(coalesce(lang, ''))))")
def chapter_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = spark.createDataFrame([("a", "src0", "EN"), ("b", "src0", ""), ("c", "src1", "x en y"), ("d", "src1", "zz")], "topic string, pub string, topic_chapter string")
    return D.topic_of_chapters(table(spark, sf_dir, "documents").select(F.col("source").alias("pub"), F.col("lang").alias("chapter")), topics)
