"""Scans: rule tables in CSV, gold sets in JSON, whole files with their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that a rule table has, and its enumerations.
REQUIRED = ("RULE_ID", "RULE_TYPE", "FORM_FAMILY", "FIELD_PATH", "RULE_TEXT", "RULE_EXPRESSION", "ERROR_CODE", "SEVERITY", "TAX_YEAR", "SCHEMA_VERSION")
NEEDED = ("RULE_ID", "ERROR_CODE", "SEVERITY", "FIELD_PATH")
SEVERITIES, RULE_TYPES = ("ERROR", "WARNING", "INFO"), ("MATH", "REJECT", "ALERT", "DATABASE")
# Other names of the columns, after headers are upper-cased and - and space have become _.
ALIASES = {
    "RULEID": "RULE_ID", "RULETYPE": "RULE_TYPE", "FORMFAMILY": "FORM_FAMILY", "FORM_NAME": "FORM_FAMILY", "FIELDPATH": "FIELD_PATH", "XPATH": "FIELD_PATH", "RULETEXT": "RULE_TEXT", "DESCRIPTION": "RULE_TEXT",
    "RULEEXPRESSION": "RULE_EXPRESSION", "EXPRESSION": "RULE_EXPRESSION", "ERRORCODE": "ERROR_CODE", "ERR_CODE": "ERROR_CODE", "TAXYEAR": "TAX_YEAR", "TAX_YR": "TAX_YEAR", "SCHEMAVERSION": "SCHEMA_VERSION",
    "SCHEMA_VER": "SCHEMA_VERSION", "VERSION": "SCHEMA_VERSION",
}
GOLD = "entries array<struct<id:string,question:string,ground_truth:string,expected_pub:string,gold_chunk_ids:array<string>,tax_year:int,difficulty:string,topic_tags:array<string>>>"


def read_rules(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The rows of a rule table, trimmed, with reject_reason (null: good). Headers are upper-cased, - and space become _, then aliases apply."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    tidy = [c.strip("﻿ \t").upper().replace("-", "_").replace(" ", "_") for c in raw.columns]
    names = ALIASES | (aliases or {})
    raw = raw.toDF(*(names.get(c, c) for c in tidy))
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    rows = raw.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in raw.columns))
    reason = F.when(F.greatest(*((F.col(c) == "").cast("int") for c in NEEDED)) == 1, "missing value").when(~F.col("SEVERITY").isin(*SEVERITIES), "severity").when(~F.col("RULE_TYPE").isin(*RULE_TYPES), "rule type")
    reason = reason.when(F.expr("try_cast(TAX_YEAR AS INT)").isNull(), "tax year")
    return rows.withColumn("reject_reason", reason)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of gold sets; unknown keys are dropped."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def write_gold(entries: DataFrame, path: str, version: str = "1.0", size: int = 10_000) -> None:
    """Gold sets of at most about so many entries each, in envelopes with a version."""
    block = F.floor(F.rand(0) * F.greatest(F.lit(1), F.ceil(F.lit(entries.count() / size)))) if "id" not in entries.columns else F.pmod(F.xxhash64("id"), F.lit(max(1, -(-entries.count() // size))))
    entries.withColumn("_b", block).groupBy("_b").agg(F.collect_list(F.struct(*entries.columns)).alias("entries")).select(F.lit(version).alias("version"), F.size("entries").alias("total"), "entries").write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON arrays of evaluation items; unknown keys are dropped."""
    kind = "id string, category string, question string, ground_truth string, expected_pubs array<string>, key_facts array<string>"
    return spark.read.schema(kind).option("multiLine", True).json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed rows of a JSON array or, by the ending of the name, a CSV file with a header; is_correct is a boolean, null where it is none."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if path.lower().rstrip("/").endswith(".csv") else spark.read.option("multiLine", True).json(path)
    return rows.withColumn("is_correct", F.col("is_correct").cast("string").try_cast("boolean")) if "is_correct" in rows.columns else rows


def write_sample(rows: DataFrame, path: str) -> None:
    """The same rows as CSV with a header and as JSON, in two folders."""
    flat = rows.select(*(F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in rows.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def write_report(report: DataFrame, path: str) -> None:
    """A report as one line of JSON a row, in one file; reports are small."""
    report.coalesce(1).write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, is_pdf) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
