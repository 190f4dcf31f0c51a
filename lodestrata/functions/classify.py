"""Ordered pattern cascades as CASE expressions: the first pattern that a text meets gives its class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents with their patterns over the lower-cased question, and confidences.
INTENTS = [
    ("form_line", r"(?:Schedule|Form|line|where|which)\s+(?:line|form|do i report|goes on|belongs)|line\s+\d+", 0.95),
    ("rule", r"what triggers|when.*required|must attach|rejection|error code|F1040-", 0.90),
    ("comparison", r"\bvs\b|\bversus\b|compared to|difference between|standard or itemized", 0.85),
    ("lookup", r"what is the|what's|how much|what are the|limits?|standard deduction|contribution limit|phase-out|income limit|\$\d|threshold|what's required|is.*required", 0.80),
    ("scenario", r"my client|a taxpayer|the client|if\s.*then|client\s+(?:sold|purchased|has|received)", 0.85),
]
# Section types with the patterns of heading or the heading above it, in order; "own" looks at the heading alone, "above" at the other.
SECTIONS = [
    ("WHATS_NEW", r"(?i)what'?s?\s+new", "both"),
    ("REMINDER", r"(?i)^reminder", "both"),
    ("PREPARER", r"(?i)paid\s+preparer", "both"),
    ("SIGNATURE", r"(?i)sign(ature|s?\s+your\s+return)", "both"),
    ("SCHEDULE_REQ", r"(?i)schedule\s+[a-z0-9]+\s+(requirement|attachment)", "own"),
    ("LINE_INSTRUCTION", r"(?i)^Lines?\s+\d", "own"),
    ("LINE_INSTRUCTION", r"(?i)line instruction", "above"),
    ("FILING_INFO", r"(?i)filing\s+(information|status|requirements?)", "both"),
]
# Rule categories with their keywords, in order.
CATEGORIES = [
    ("income_limits", ["phase-out", "phaseout", "limit", "threshold", "deduction limit", "IRADeduction", "StudentLoan", "ChildTaxCredit", "AOTC"]),
    ("contribution_caps", ["401k", "HSA", "IRA contribution", "contribution limit", "cannot exceed", "annual limit"]),
    ("required_attachments", ["must be attached", "required when", "must be present", "requires Schedule", "requires Form"]),
    ("math_validation", ["must equal", "= [", "sum of", "SUM(", "total must", "must reconcile"]),
    ("cross_form_refs", ["Form 8960", "Schedule D", "Schedule A", "Schedule E", "1099", "W-2", "SUM([IRS"]),
]
# References in texts.
REFERENCES = {"forms": r"(?i)\bForm\s+([\w\-]+\d[\w\-]*)", "schedules": r"(?i)\bSchedule\s+([A-Z0-9\-]+)", "lines": r"(?i)\blines?\s+(\d+[a-z]?)", "pubs": r"(?i)\bPub(?:lication)?\.\s*(\d+[\w\-]*)"}


def cascade(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = cases
    return reduce(lambda c, kv: c.when(*kv), rest, F.when(*first)).otherwise(otherwise)


def intent(text: Column) -> Column:
    """struct(intent, confidence); null is the empty question."""
    lower, pair = F.lower(F.coalesce(text, F.lit(""))), lambda n, c: F.struct(F.lit(n).alias("intent"), F.lit(c).alias("confidence"))
    return cascade([(lower.rlike(p), pair(n, c)) for n, p, c in INTENTS], pair("general", 0.50))


def section_type(heading: Column, above: Column) -> Column:
    h, a = F.coalesce(heading, F.lit("")), F.coalesce(above, F.lit(""))
    met = {"own": lambda p: h.rlike(p), "above": lambda p: a.rlike(p), "both": lambda p: a.rlike(p) | h.rlike(p)}
    return cascade([(met[where](p), F.lit(n)) for n, p, where in SECTIONS], F.lit("GENERAL"))


def rule_category(text: Column, expression: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(expression, F.lit(""))))
    return cascade([(reduce(lambda x, y: x | y, (both.contains(k.lower()) for k in keys)), F.lit(n)) for n, keys in CATEGORIES], F.lit("other"))


def references(text: Column) -> dict[str, Column]:
    """Distinct references of each kind in order of their first place."""
    return {n: F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1))) for n, p in REFERENCES.items()}
