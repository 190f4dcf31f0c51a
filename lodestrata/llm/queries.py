"""The queries of this subpackage and, where SQL can express one, its equivalent for DuckDB."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audio, line_dedup, mixing, packing, quality_classifier, quality_rules, runs, sharding, simhash, token_files, toxicity, url_filter
from .common import WORD, fold, learnable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, learnable(labels, 4, 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, toxicity.toxicity("text", model).alias("t"))
    return scored.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.3).cast("int").alias("predicted"), F.size("t.sentences").alias("n_sentences"), F.col("t.sentences").alias("sentences"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "rule string, action string")
    return url_filter.decide(_table(spark, sf_dir, "pages"), rules).select("page_id", "decision.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, learnable(labels, 5, 0))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return quality_classifier.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("deleted.lines").alias("lines_deleted"), F.col("deleted.words").alias("words_deleted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("domain", mixing.source_domain())
    return mixing.mix(docs, F.col("domain"), mixing.DOMAINS).select("doc_id", "domain", "lang", "source", "epoch")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(spark, _table(spark, sf_dir, "documents"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.render(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return audio.align(media.select("id", audio.chroma_print("media").alias("print")), F.coalesce(F.col("id") % 20 == 0, F.lit(False)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.cut(_table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    judged = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.learn(docs, labels))
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in wanted))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    split = _table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    split = split.select("doc_id", "text", "words", F.when(n > 0, a).alias("a"), F.when(n > 0, (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")).alias("p"))
    again = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    planted = split.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = planted.select("doc_id", runs.periodic_runs("text", 6, 4).alias("r")).select("doc_id", "r.runs", "r.collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) DIV -best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), exponent, "runs_sha256", "collapsed_sha256")


def op12_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    data = F.encode("text", "UTF-8")
    slim = docs.select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"), F.xxhash64("text").alias("copy"))
    done = sharding.sharded(slim, F.col("size"), ["n_chars", "lang", "source", "doc_id"], shards=8, group=F.col("copy"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _groups_sha256(p: alignment.Portion) -> list[str]:
    """Of each text the sha-256 of its groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    n_a, n_b = p.in_group()
    size = len(p.a) + len(p.b)
    ids, mark = np.empty(size, np.int64), np.full(size, ord(","), np.uint8)
    a_place = np.arange(len(p.a)) + (np.cumsum(n_b) - n_b)[p.a_group]
    b_place = np.arange(len(p.b)) + np.cumsum(n_a)[p.b_group]
    ids[a_place], ids[b_place] = p.a, p.b
    ends = np.cumsum(n_a + n_b) - 1
    mark[ends - n_b], mark[ends] = ord("|"), ord(";")
    digits = np.full((size, 6), 0, np.uint8)
    digits[:, 5] = mark
    left = ids.copy()
    for k in range(4, -1, -1):
        digits[:, k] = np.where((left > 0) | (k == 4), left % 10 + 48, 0)
        left //= 10
    used = digits > 0
    flat = memoryview(digits[used])
    at = np.concatenate(([0], np.cumsum(used.sum(1))))[p.a_at + p.b_at].tolist()
    return [hashlib.sha256(flat[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.linked(_table(spark, sf_dir, "documents"), extra=_groups_sha256)
    return found.withColumnRenamed("extra", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_simhash_near_dedup, op4_quality_classifier, op5_line_dedup, op6_mixing, op7_token_files, op8_audio, op9_packing, op10_quality_rules, op11_periodic_runs, op12_kd_sharding, op13_alignment)}
OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
         regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') AS link, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS meta FROM pages
), q AS (
  SELECT *, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         split_part(url, '#', 1) AS node FROM p
), e AS (
  SELECT node AS u, split_part(v, '#', 1) AS v FROM (
    SELECT node, regexp_extract(link, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS v FROM q UNION ALL SELECT node, regexp_extract(meta, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM q) WHERE v <> ''
), undirected AS (
  SELECT u, v FROM e UNION SELECT v, u FROM e
), reach AS (
  SELECT u AS a, v AS b FROM undirected UNION SELECT reach.a, undirected.v FROM reach JOIN undirected ON reach.b = undirected.u
), rules(rule, action, h, s) AS (
  VALUES ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'block', 'net', '/de/'), ('example.net/de/8', 'allow', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')
), own AS (
  SELECT q.page_id, any_value(q.node) AS node, max_by(r.rule, length(r.rule)) AS rule, max_by(r.action, length(r.rule)) AS action
  FROM q LEFT JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.s) GROUP BY q.page_id
), carried AS (
  SELECT o.page_id, max(CASE x.action WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS rank FROM own o JOIN reach ON reach.a = o.node JOIN own x ON x.node = reach.b GROUP BY o.page_id
)
SELECT q.page_id, q.host, q.path, o.rule, coalesce(o.action, CASE WHEN c.rank = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN own o ON o.page_id = q.page_id LEFT JOIN carried c ON c.page_id = q.page_id
"""

OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), x AS (
  SELECT doc_id, line, n, words, row_number() OVER d AS p, sum(words) OVER (d ROWS UNBOUNDED PRECEDING) AS till FROM w WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY n)
), spans AS (
  SELECT o.doc_id, o.p AS s, min(c.p) AS e FROM x o JOIN x c ON c.doc_id = o.doc_id AND c.p >= o.p AND c.till - (o.till - o.words) >= 50 GROUP BY ALL
  UNION
  SELECT c.doc_id, max(o.p), c.p FROM x c JOIN x o ON c.doc_id = o.doc_id AND c.p >= o.p AND c.till - (o.till - o.words) >= 50 GROUP BY c.doc_id, c.p
), runs AS (
  SELECT s.doc_id, s.s, s.e, string_agg(x.line, chr(10) ORDER BY x.p) AS lines FROM spans s JOIN x ON x.doc_id = s.doc_id AND x.p BETWEEN s.s AND s.e GROUP BY ALL
), first AS (
  SELECT *, first_value(doc_id) OVER f AS fd, first_value(e) OVER f AS fe FROM runs WINDOW f AS (PARTITION BY lines ORDER BY doc_id, s)
), gone AS (
  SELECT DISTINCT x.doc_id, x.n, x.words FROM first r JOIN x ON x.doc_id = r.doc_id AND x.p BETWEEN r.s AND r.e WHERE r.doc_id <> r.fd OR r.s > r.fe
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(g.lines, 0) AS lines_deleted, coalesce(g.words, 0) AS words_deleted
FROM documents d
LEFT JOIN (SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.n) AS text FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.n = w.n WHERE g.n IS NULL GROUP BY w.doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS lines, sum(words)::BIGINT AS words FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, 'domain' || (try_cast(substr(source, 4) AS INT) % 4) AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), n1 AS (
  SELECT domain, sum(tokens)::HUGEINT * 2 AS cap, CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight, (SELECT sum(tokens) FROM leaf)::HUGEINT AS budget FROM leaf GROUP BY ALL
), r1 AS (
  SELECT *, row_number() OVER o AS rank, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM n1 WINDOW o AS (ORDER BY cap / weight, domain)
), q1 AS (
  SELECT domain, CASE WHEN cap * heft <= rest * weight THEN cap ELSE least(cap, first[1] * weight // first[2]) END AS quota
  FROM (SELECT *, min_by([rest, heft], CASE WHEN cap * heft > rest * weight THEN rank END) OVER () AS first FROM r1)
), n2 AS (
  SELECT domain, lang, sum(tokens)::HUGEINT * 2 AS cap, CASE lang WHEN 'en' THEN 11 ELSE 3 END AS weight, any_value(quota) AS budget FROM leaf JOIN q1 USING (domain) GROUP BY domain, lang
), r2 AS (
  SELECT *, row_number() OVER o AS rank, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM n2 WINDOW o AS (PARTITION BY domain ORDER BY cap / weight, lang)
), q2 AS (
  SELECT domain, lang, CASE WHEN cap * heft <= rest * weight THEN cap ELSE least(cap, first[1] * weight // first[2]) END AS quota
  FROM (SELECT *, min_by([rest, heft], CASE WHEN cap * heft > rest * weight THEN rank END) OVER (PARTITION BY domain) AS first FROM r2)
), n3 AS (
  SELECT domain, lang, source, tokens, tokens::HUGEINT * 2 AS cap, CASE source WHEN 'src0' THEN 2 ELSE 1 END AS weight, quota AS budget FROM leaf JOIN q2 USING (domain, lang)
), r3 AS (
  SELECT *, row_number() OVER o AS rank, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM n3 WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / weight, source)
), q3 AS (
  SELECT domain, lang, source, tokens AS leaf_tokens, CASE WHEN cap * heft <= rest * weight THEN cap ELSE least(cap, first[1] * weight // first[2]) END AS quota
  FROM (SELECT *, min_by([rest, heft], CASE WHEN cap * heft > rest * weight THEN rank END) OVER (PARTITION BY domain, lang) AS first FROM r3)
), k AS (
  SELECT d.*, quota, CASE WHEN leaf_tokens > 0 THEN quota // leaf_tokens ELSE 1 END AS whole, CASE WHEN leaf_tokens > 0 THEN quota % leaf_tokens ELSE 0 END AS rest FROM d JOIN q3 USING (domain, lang, source)
), t AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || whole || ':' || doc_id)) AS till FROM k
), c AS (
  SELECT *, (whole + CASE WHEN rest > 0 AND till <= rest THEN 1 ELSE 0 END)::INT AS copies FROM t
)
SELECT doc_id, domain, lang, source, unnest(range(copies))::INT AS epoch FROM c
"""

ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op5_line_dedup": OP5_SQL, "op6_mixing": OP6_SQL}
