"""Queries: graph tables, anchors, scopes by topic, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import knowledge as K

from .registry import query, table


@query("SELECT 'Customer' AS label, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT 'Nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'Region', r_regionkey::VARCHAR FROM region")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return K.nodes(t("customer"), "Customer", "c_custkey", "c_name").unionByName(K.nodes(t("nation"), "Nation", "n_nationkey", "n_name")).unionByName(K.nodes(t("region"), "Region", "r_regionkey", "r_name")).select("label", "id")


@query("SELECT DISTINCT o_custkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, 'BOUGHT' AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT c_custkey::VARCHAR, c_nationkey::VARCHAR, 'LIVES_IN' FROM customer")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return K.edges(bought, "BOUGHT", "o_custkey", "l_partkey").unionByName(K.edges(table(spark, sf_dir, "customer"), "LIVES_IN", "c_custkey", "c_nationkey"))


@query("WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS seen, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, sum(n)::BIGINT AS n, min(seen) AS first, array_to_string(list(p_type ORDER BY seen)[1:5], ',') AS headings FROM f GROUP BY p_brand")
def group_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.anchors(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type", 5).withColumn("headings", F.array_join("headings", ","))


_TERMS = [("steel", "STEEL"), ("metal", "STEEL"), ("metal", "BRASS"), ("metal", "COPPER"), ("shape", "ECONOMY"), ("shape", "SMALL"), ("coat", "PLATED"), ("coat", "ANODIZED")]


@query("WITH t(topic, term) AS (VALUES " + ", ".join(str(t) for t in _TERMS) + ") SELECT p_partkey, coalesce(string_agg(topic, ',' ORDER BY n DESC, topic), '') AS topics FROM part LEFT JOIN (SELECT p_partkey, topic, count(*) AS n FROM part JOIN t ON contains(lower(p_type), lower(term)) GROUP BY ALL) USING (p_partkey) GROUP BY p_partkey")
def topic_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.topics_of(table(spark, sf_dir, "part"), spark.createDataFrame(_TERMS, "topic string, term string"), "p_type")
    return found.select("p_partkey", F.array_join("topics", ",").alias("topics"))


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS rate, count(*) >= 3 AND round(avg((value > 50)::INT), 6) < 0.5 AS systematic FROM events WHERE value IS NOT NULL GROUP BY event_type")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.review_scores(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 50), "event_type", "ok")


@query("SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE '' END AS slice, lang, source, count(*) AS n, round(avg(coalesce(quality = 1, false)::INT), 6) AS pass_rate, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, min(quality) AS min_quality, max(quality) AS max_quality, min(toxic) AS min_toxic, max(toxic) AS max_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))")
def judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements cover some rows: means are over those, the pass rate over all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return K.judge_report(rows, ["lang", "source"], ["quality", "toxic"], F.col("quality") == 1, extremes=True)


@query("SELECT l_suppkey, count(*) AS n, string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey) AS questions FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') e WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND orders.o_custkey = e.o_custkey AND lineitem.l_suppkey = e.l_suppkey) GROUP BY l_suppkey")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of open orders that the customer's finished orders lack, with all the customers of each."""
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    gaps = K.missed(both.filter("o_orderstatus = 'O'"), both.filter("o_orderstatus = 'F'"), "o_custkey", "l_suppkey")
    return gaps.withColumn("questions", F.array_join(F.transform("questions", lambda q: q.cast("string")), ","))
