"""Gates: tables of checks (check, value, passed) over relations. Each is one aggregation, or a join of two small ones; a gate passes if all of its rows do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import rule_language as L
from lodestrata.sources.readers import RULE_TYPES, SEVERITIES

from .knowledge import review_scores

AST_RATE, REVIEW_RATE, ERROR_GATE, WARNING_GATE, LINK_RATE, FIELD_RATE = 0.98, 0.95, 1.0, 0.95, 0.70, 0.70
SECTIONS, LINE_SECTIONS, CHUNKS, DIMENSION, PAGES, TOKENS, EMBEDDED = 10, 5, 10, 1536, 5, (50, 650), 95.0
CONTEXTS, LEAST_SCORE, ANSWER, RETRIEVAL_MS, SYNTHESIS_MS = 3, 0.40, 80, 20_000, 30_000
ENTRIES, PER_PUB, QUESTION_LENGTH, ANSWER_LENGTH, DIFFICULTIES = 40, 3, 30, 50, ("simple", "medium", "complex")
HIT_RATE, PASS_RATE = 0.50, 0.75
CHUNK_ID = r"^p\w+-\d{4}::\d{4}$"


def judged(row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check, value, passed) of a table of one row: for each check the column of its value and that of whether it passes (null doesn't)."""
    each = F.array(*(F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, (v, ok) in checks.items()))
    return row.select(F.explode(each).alias("c")).select("c.*")


def _none(rows: DataFrame, failing: dict[str, Column], more: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """One row with counts of failing rows (null counts), and the checks that each is 0."""
    return rows.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in failing.items()), *(c.alias(n) for n, c in (more or {}).items())), {n: (F.col(n), F.col(n) == 0) for n in failing}


def failing_rows(rows: DataFrame, checks: dict[str, Column], id_col: str, most: int = 5) -> DataFrame:
    """(check, ids): for each check the smallest ids of rows that fail it (null fails), at most so many of each."""
    failed = F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()))))
    each = rows.select(F.col(id_col).cast("string").alias("id"), failed.alias("check"))
    from pyspark.sql import Window

    few = each.withColumn("n", F.row_number().over(Window.partitionBy("check").orderBy("id"))).filter(F.col("n") <= most)
    return few.groupBy("check").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _readable(rules: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in rules:
        yield pa.array([not L.unread({"": r or ""}) for r in array.to_pylist()], pa.bool_())


def readable(expression: Column | str) -> Column:
    """Whether a rule can be read."""
    return F.arrow_udf(_readable, "boolean")(expression)


def rules_gate(rules: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """V1.1 over read_rules: rows as expected, no row without a needed value, no key twice, nearly all expressions read, known enumerations."""
    good = rules.filter("reject_reason IS NULL")
    twice = good.groupBy("RULE_ID", "TAX_YEAR", "SCHEMA_VERSION").count().filter("count > 1").agg(F.count("*").alias("DUPLICATE_RULE_IDS"))
    read = good.agg(F.coalesce(F.avg(readable("RULE_EXPRESSION").cast("int")), F.lit(0.0)).alias("AST_PARSE_RATE"))
    known = F.col("RULE_TYPE").isin(*RULE_TYPES) & F.col("SEVERITY").isin(*SEVERITIES)
    row, checks = _none(rules, {"NULL_FIELDS": F.coalesce(F.col("reject_reason") == "missing value", F.lit(False)), "ENUM_VALUES": ~known}, {"ROW_COUNT": F.count("*")})
    checks |= {"ROW_COUNT": (F.col("ROW_COUNT"), F.lit(True) if expected_rows is None else F.col("ROW_COUNT") == expected_rows), "DUPLICATE_RULE_IDS": (F.col("DUPLICATE_RULE_IDS"), F.col("DUPLICATE_RULE_IDS") == 0), "AST_PARSE_RATE": (F.col("AST_PARSE_RATE"), F.col("AST_PARSE_RATE") >= AST_RATE)}
    return judged(row.crossJoin(twice).crossJoin(read), checks)  # each of one row


def review_gate(reviews: DataFrame, category: str, correct: str) -> DataFrame:
    """V1.2: the share of correct reviews, and the number of categories that are wrong systematically."""
    overall = reviews.agg(F.avg(F.col(correct).cast("int")).alias("rate"))
    bad = review_scores(reviews, category, correct).agg(F.count_if("systematic").alias("systematic"))
    return judged(overall.crossJoin(bad), {"ACCURACY": (F.col("rate"), F.col("rate") >= REVIEW_RATE), "SYSTEMATIC": (F.col("systematic"), F.col("systematic") == 0)})


def replay_gate(replayed: DataFrame, severity: str | None = None) -> DataFrame:
    """V1.3 over rule_language.replay: the share of cases that match, of severity WARNING (a column) and of all others. No cases: 1."""
    warned = F.col(severity) == "WARNING" if severity else F.lit(False)
    rate = lambda of: F.coalesce(F.avg(F.when(of, F.col("matches").cast("int"))), F.lit(1.0))
    row = replayed.agg(rate(~F.coalesce(warned, F.lit(False))).alias("e"), rate(warned).alias("w"))
    return judged(row, {"ERROR_MATCH": (F.col("e"), F.col("e") >= ERROR_GATE), "WARNING_MATCH": (F.col("w"), F.col("w") >= WARNING_GATE)})


def regression_gate(judged_cases: DataFrame) -> DataFrame:
    """V1.4 over rule_language.regression: no outcome turned without a changed rule."""
    return judged(*_none(judged_cases, {"UNEXPECTED": F.col("change") == "unexpected"}))


def sections_gate(sections: DataFrame) -> DataFrame:
    """V2.1: sections (heading, text, level as a number, line, field_names) in number, with headings and texts; lines that map to fields."""
    lines = F.col("line").isNotNull()
    row, checks = _none(sections, {"EMPTY_CONTENT": (F.col("level") > 2) & (F.trim(F.coalesce("text", F.lit(""))) == ""), "HEADING_QUALITY": F.trim(F.coalesce("heading", F.lit(""))) == ""}, {"n": F.count("*"), "lines": F.count_if(lines), "rate": F.coalesce(F.avg(F.when(lines, (F.size("field_names") > 0).cast("int"))), F.lit(1.0))})
    return judged(row, checks | {"SECTION_COUNT": (F.col("n"), F.col("n") >= SECTIONS), "LINE_SECTIONS": (F.col("lines"), F.col("lines") >= LINE_SECTIONS), "FIELD_MAP_RATE": (F.col("rate"), F.col("rate") >= FIELD_RATE)})


def link_gate(fields: DataFrame, sections: DataFrame) -> DataFrame:
    """V2.2: the share of known fields (field) that a section's field_names have."""
    covered = sections.select(F.explode("field_names").alias("field")).distinct().withColumn("met", F.lit(1))
    row = fields.select("field").distinct().join(covered, "field", "left").agg(F.coalesce(F.avg(F.coalesce("met", F.lit(0))), F.lit(1.0)).alias("rate"))
    return judged(row, {"FORMLINE_COVERAGE": (F.col("rate"), F.col("rate") >= LINK_RATE)})


def uncovered_fields(fields: DataFrame, sections: DataFrame) -> DataFrame:
    return fields.select("field").distinct().join(sections.select(F.explode("field_names").alias("field")), "field", "left_anti")


def chunks_gate(chunks: DataFrame, dimension: int = DIMENSION, pattern: str = CHUNK_ID) -> DataFrame:
    """V3.1 for each publication: (pub_id, check, value, passed) over chunk_id, chunk_index, text, token_count, page_start, form_refs, line_refs, embedding."""
    twice = lambda c: F.size(c) != F.size(F.array_distinct(c))
    failing = {
        "B_TEXT": F.trim(F.coalesce("text", F.lit(""))) == "", "C_TOKENS": ~(F.col("token_count") > 0), "E_PAGES": ~(F.col("page_start") >= 1), "F_IDS": ~F.col("chunk_id").rlike(pattern),
        "G_REFS": F.coalesce(twice("form_refs"), F.lit(False)) | F.coalesce(twice("line_refs"), F.lit(False)), "H_DIMENSION": F.coalesce(F.size("embedding") != dimension, F.lit(False)) & F.col("embedding").isNotNull(),
    }
    counted = chunks.groupBy("pub_id", "chunk_index").agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in failing.items()))
    row = counted.groupBy("pub_id").agg(F.sum("rows").alias("A_COUNT"), F.count_if(F.col("rows") > 1).alias("D_INDEX"), *(F.sum(n).alias(n) for n in failing))
    checks = {"A_COUNT": F.col("A_COUNT") >= CHUNKS} | {n: F.col(n) == 0 for n in ("D_INDEX", *failing)}
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), ok.alias("passed")) for n, ok in checks.items()))
    return row.select("pub_id", F.explode(each).alias("c")).select("pub_id", "c.*")


def coverage_gate(expected: DataFrame, chunks: DataFrame, embedded: bool = False) -> DataFrame:
    """V3.2: (pub, chunks, embedded_pct, avg_tokens, passed, thin) of each expected publication (pub, page_count). thin: so few pages that it may be cut off."""
    found = chunks.groupBy("pub").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.avg("token_count").alias("avg_tokens"))
    rows = expected.join(found, "pub", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    pct = F.coalesce(100 * F.col("embedded") / F.nullif("chunks", F.lit(0)), F.lit(0.0))
    fine = (F.col("chunks") >= CHUNKS) & (F.coalesce("avg_tokens", F.lit(0.0)) .isin(0.0) | F.col("avg_tokens").between(*TOKENS))
    fine = fine & (F.round(pct, 9) >= EMBEDDED) if embedded else fine
    return rows.select("pub", "chunks", F.round(pct, 1).alias("embedded_pct"), F.round("avg_tokens", 6).alias("avg_tokens"), F.coalesce(fine, F.lit(False)).alias("passed"), ((F.col("page_count") > 0) & (F.col("page_count") < PAGES)).alias("thin"))


def probes_gate(probes: DataFrame, results: DataFrame) -> DataFrame:
    """V3.3: (qid, rank, score, passed) for each probe (qid, pub, min_score, within, contains): its publication among the first results, with that score and text. results: qid, rank, pub, score, text."""
    met = probes.join(results.withColumnRenamed("pub", "found"), "qid", "left")
    hit = (F.col("found") == F.col("pub")) & (F.col("rank") <= F.col("within"))
    first = met.groupBy("qid", "min_score", "contains").agg(F.min_by(F.struct("rank", "score", "text"), F.when(hit, F.col("rank"))).alias("hit"))
    ok = (F.col("hit.score") >= F.col("min_score")) & (F.col("contains").isNull() | F.contains(F.lower("hit.text"), F.lower("contains")))
    return first.select("qid", F.col("hit.rank").alias("rank"), F.col("hit.score").alias("score"), F.coalesce(ok, F.lit(False)).alias("passed"))


def agent_gate(answers: DataFrame) -> DataFrame:
    """V4.1 over answers (qid, contexts, min_score, answer, citations, retrieval_ms, synthesis_ms): how many fail each check."""
    return judged(*_none(answers, {
        "A_CONTEXTS": F.col("contexts") < CONTEXTS, "B_SCORE": F.col("min_score") < LEAST_SCORE, "C_ANSWER": F.length(F.trim("answer")) < ANSWER, "D_CITATION": F.col("citations") < 1,
        "E_RETRIEVAL": F.col("retrieval_ms") > RETRIEVAL_MS, "F_SYNTHESIS": F.col("synthesis_ms") > SYNTHESIS_MS,
    }))


def gold_gate(entries: DataFrame, expected: list[str], least: int = ENTRIES, per_pub: int = PER_PUB, difficulties: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """V5.1 over gold entries (question, ground_truth, expected_pub, difficulty): size, publications, difficulties, median lengths, repeated questions."""
    sums = lambda col, wanted, n: reduce_sum(F.count_if(F.col(col) == w) < n for w in wanted)
    row = entries.agg(
        F.count("*").alias("n"), sums("expected_pub", expected, per_pub).alias("pubs"), sums("difficulty", difficulties, 1).alias("tiers"), F.median(F.length("question")).alias("q"), F.median(F.length("ground_truth")).alias("a"),
        (F.count("question") - F.count_distinct(F.lower(F.trim("question")))).alias("again"),
    )
    return judged(row, {
        "A_SIZE": (F.col("n"), F.col("n") >= least), "B_PUBLICATIONS": (F.col("pubs"), F.col("pubs") == 0), "C_DIFFICULTY": (F.col("tiers"), F.col("tiers") == 0), "D_QUESTIONS": (F.col("q"), F.col("q") >= QUESTION_LENGTH),
        "E_ANSWERS": (F.col("a"), F.col("a") >= ANSWER_LENGTH), "F_REPEATED": (F.col("again"), F.col("again") == 0),
    })


def reduce_sum(conditions) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def rate_gate(report: DataFrame, column: str, least: float) -> DataFrame:
    """The command line's gates: a rate of a report of one row is high enough (HIT_RATE of a ranking, PASS_RATE of judged answers)."""
    return judged(report, {column: (F.col(column), F.col(column) >= least)})
