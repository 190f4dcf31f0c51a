"""Queries: business rules over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import rule_language as L
from lodestrata.functions import rule_tables as T

from .registry import query, table

RULES = {
    "L-001": "If [l_returnflag] IN ('R') Then [l_discount] must not exceed 0.05",
    "L-002": "If [l_linestatus] = 'O' Then [l_returnflag] = 'N' Else [l_quantity] must be at least 2",
    "L-003": "[l_extendedprice] / [l_quantity] <= 1500",
    "L-004": "If [l_quantity] > 40 OR [l_discount] > 0.08 AND [l_tax] > 0.04 Then MAX([l_discount], [l_tax]) <= 0.07",
    "L-005": "If [l_missing] > 1 Then [l_quantity] = 0",
    "L-006": "ABS([l_discount] - [l_tax]) <= 0.07",
    "L-007": "If [l_missing] is not present Then [l_quantity] is present AND SUM([l_discount], [l_missing]) >= 0.01",
}
ERRORS = ["L-001", "L-003"]
_SQL = """
r AS (SELECT l_orderkey, l_linenumber, [
  CASE WHEN l_returnflag = 'R' AND NOT l_discount <= 0.05 THEN 'L-001' END,
  CASE WHEN CASE WHEN l_linestatus = 'O' THEN l_returnflag <> 'N' ELSE l_quantity < 2 END THEN 'L-002' END,
  CASE WHEN l_quantity <> 0 AND l_extendedprice / l_quantity > 1500 THEN 'L-003' END,
  CASE WHEN (l_quantity > 40 OR l_discount > 0.08) AND l_tax > 0.04 AND greatest(l_discount, l_tax) > 0.07 THEN 'L-004' END,
  CASE WHEN abs(l_discount - l_tax) > 0.07 THEN 'L-006' END,
  CASE WHEN coalesce(l_discount, 0) < 0.01 THEN 'L-007' END] AS f FROM lineitem)
"""


@query(f"WITH {_SQL} SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter(f, lambda x: x IS NOT NULL)) AS rule FROM r) GROUP BY rule")
def rule_violations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records break each rule: one pass over the table inside generated code."""
    fired = L.violations(table(spark, sf_dir, "lineitem"), RULES)
    return fired.select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {_SQL} SELECT l_orderkey, CASE WHEN bool_or(list_contains(f, 'L-001') OR list_contains(f, 'L-003')) THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome FROM r GROUP BY l_orderkey")
def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is rejected if one of its lines breaks a rule of severity ERROR."""
    lines = L.violations(table(spark, sf_dir, "lineitem"), RULES).select("l_orderkey", (L.outcome(F.col("fired"), ERRORS) == "REJECTED").alias("bad"))
    return lines.groupBy("l_orderkey").agg(F.when(F.bool_or("bad"), "REJECTED").otherwise("ACCEPTED").alias("outcome"))


@query(f"WITH {_SQL} SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter(f, lambda x: x IS NOT NULL)) AS rule FROM r) GROUP BY rule")
def rule_violations_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over records that are maps of texts, with the rules in a table."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = [x for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax") for x in (F.lit(c), F.col(c).cast("string"))]
    rules = T.compiled(spark.createDataFrame(list(RULES.items()), "rule_id string, expression string"))
    fired = T.fired_by(lines.select(F.create_map(*pairs).alias("record")), rules, "record")
    return fired.select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_BOUNDS = range(1, 51)


@query("WITH b AS (SELECT unnest(range(1, 51)) AS i), k AS (SELECT p_partkey, to_json({'size': p_size, 'brand': p_brand, 'price': p_retailprice}) AS r FROM part), v AS (SELECT p_partkey, (r->>'size')::INT AS size, r->>'brand' AS brand FROM k) SELECT p_partkey, count(*) FILTER (size IS NOT NULL AND NOT size <= i) AS over, count(*) FILTER (i % 5 = 0 AND brand = 'Brand#' || (i // 5) || '1' AND NOT size >= i) AS under FROM v, b GROUP BY p_partkey")
def rule_table_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules over VARIANT objects: bounds of the size, some of them for one brand alone."""
    record = F.parse_json(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))))
    listed = [(f"over-{i}", f"[size] <= {i}") for i in _BOUNDS] + [(f"under-{i}", f"If [brand] = 'Brand#{i // 5}1' Then [size] >= {i}") for i in _BOUNDS if i % 5 == 0]
    rules = T.compiled(spark.createDataFrame(listed, "rule_id string, expression string"))
    fired = T.fired_by(table(spark, sf_dir, "part").select("p_partkey", record.alias("record")), rules, "record")
    count = lambda head: F.size(F.filter("fired", lambda r: F.startswith(r, F.lit(head)))).cast("bigint").alias(head.rstrip("-"))
    return fired.select("p_partkey", count("over-"), count("under-"))
