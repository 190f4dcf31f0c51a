"""What a question says about itself: years, forms, publications, topics, terms and numbers. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import small

DEFAULT_YEAR, FIRST_YEAR, LAST_YEAR = 2025, 1950, 2050
# Patterns of years, references and comparisons.
YEAR = r"\b([12]\d{3})\b"
ACTION_YEAR = r"(?i)(?:claim|deduct(?:ion)?|file|report|owe|pay(?:ing)?|tax(?:es)?|returns?)\b.*?\b([12]\d{3})\b"
TAX_YEAR = r"(?i)tax year\s+([12]\d{3})\b"
COMPARING = r"\bvs\.?\b|\bversus\b|\bcompare[ds]?\b|\bcomparison\b|\bdifference\s+between\b|\bchanged?\s+(?:from|between|since)\b|\bbetween\s+\d{4}\s+and\s+\d{4}\b|\bfrom\s+\d{4}\s+to\s+\d{4}\b"
FORM, SCHEDULE = r"(?i)Form\s+(\d{4}(?:-[A-Z]{1,2})?)", r"(?i)Schedule\s+([A-Z])"
PUBLICATION = r"(?i)(?:Pub(?:lication)?\.?\s+)?(\d{1,3}(?:[a-z])?)"
ERROR_CODE = r"F\d{4}-\d{3}"
# Patterns of amounts, shares and large numbers, and of what counts as an entity.
NUMBERS = (r"\$[\d,]+", r"\b\d+(?:\.\d+)?%", r"\b\d{1,3}(?:,\d{3})+\b")
ENTITY = r"(?i)\$[\d,]+(?:\.\d{2})?|\b\d{1,3}(?:,\d{3})+\b|\b\d+(?:\.\d+)?%\b|\bForm\s+\d[\w-]*\b|\bSchedule\s+[A-Z][\w-]*\b|\bSection\s+\d+[A-Za-z]?\b|\bPub(?:lication)?\s+\d+\b"
# Words that say nothing in a question.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during "
    "after above below between under again further then once here there when where why how all both each few more most other some such no not only own same so than too "
    "very just about also and but or if because what which who whom this that these those am its it my me i we our you your he she they them his her their"
).split()
# Phrases that refer to an excerpt, taken out of a question in this order.
EXCERPTS = [
    r"(?i),?\s*according to the excerpt[,.]?", r"(?i),?\s*as stated in the excerpt[,.]?", r"(?i),?\s*as described in the excerpt[,.]?", r"(?i),?\s*as mentioned in the excerpt[,.]?",
    r"(?i)\bunder the excerpt\b[,.]?", r"(?i)\bin (this|the) excerpt\b[,.]?", r"(?i)\bthe excerpt states?\b[,.]?",
    r"(?i)\bthe excerpt (describes?|mentions?|provides?|lists?|outlines?|says?|defines?)\b[,.]?", r"(?i)\bdescribed in the excerpt\b[,.]?", r"(?i)\bmentioned in the excerpt\b[,.]?",
    r"(?i)\bprovided in the excerpt\b[,.]?", r"(?i)\bthe excerpt\b",
]
# Topics with the patterns of their words.
TOPICS = [
    ("earned-income-credit", r"earned income credit|\bEIC\b|\bEITC\b"),
    ("hsa", r"\bHSA\b|health savings|\bHDHP\b"),
    ("ira", r"\bIRA\b|individual retirement|traditional IRA|\bRoth\b"),
    ("retirement", r"retirement account|retirement plan|401\(k\)|\b403\(b\)\b"),
    ("investments", r"capital gain|investment income|dividend|\bstock\b"),
    ("capital-gains", r"capital gain|long-term gain|short-term gain"),
    ("depreciation", r"depreciation|section 179|\bMACRS\b|bonus depreciation"),
    ("business-property", r"business property|fixed assets|property equipment"),
    ("rental-property", r"rental property|rental income|landlord"),
    ("home-sale", r"home sale|selling.*home|section 121|primary residence"),
    ("self-employment", r"self-employed|self-employment|\bSchedule C\b|sole proprietor"),
    ("business", r"\bbusiness\b|trade or business|small business"),
    ("estimated-tax", r"estimated tax|quarterly payment|safe harbor"),
    ("deductions", r"standard deduction|itemized|\bSchedule A\b"),
    ("dependents", r"dependent|qualifying child|qualifying relative"),
    ("filing-status", r"filing status|married filing|head of household|\bsingle\b"),
    ("rmd", r"\bRMD\b|required minimum|life expectancy"),
    ("retirement-distributions", r"retirement distribution|distribution rules"),
    ("contribution-limits", r"contribution limit|deduction limit|phase-out"),
    ("mortgage-interest", r"mortgage interest|home mortgage|\bpoints\b"),
    ("charitable-contributions", r"charitable|donation|\bForm 8283\b"),
    ("medical-expenses", r"medical expense|dental"),
    ("education", r"education credit|\bAOTC\b|lifetime learning|\b529\b"),
    ("alimony-divorce", r"alimony|divorce|separation"),
    ("gambling", r"gambling|lottery|prize"),
    ("foreign-income", r"foreign tax|foreign income|FBAR"),
    ("amt", r"\bAMT\b|alternative minimum"),
    ("health-plans", r"health plan|HSA|HDHP"),
]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def years(text: Column) -> Column:
    """Plausible years in their order."""
    found = F.transform(F.regexp_extract_all(_text(text), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def tax_year(text: Column, default: int = DEFAULT_YEAR) -> Column:
    """The year a question asks about: this, last or next year; the only year named; the year after a verb of acting; that after "tax year"; the latest. Null: none named."""
    low, all_years = F.lower(_text(text)), years(text)
    number = lambda p: F.regexp_extract(_text(text), p, 1).try_cast("int")
    action = number(ACTION_YEAR)
    said = F.when(low.rlike(r"\bthis year\b"), default).when(low.rlike(r"\blast year\b"), default - 1).when(low.rlike(r"\bnext year\b"), default + 1)
    many = F.when(action.between(FIRST_YEAR, LAST_YEAR), action).when(number(TAX_YEAR).isNotNull(), number(TAX_YEAR)).otherwise(F.array_max(all_years))
    return said.when(F.size(all_years) == 1, F.get(all_years, F.lit(0))).when(F.size(all_years) > 1, many)


def comparison_years(text: Column) -> Column:
    """The distinct years of a question that compares, in order; empty with fewer than two."""
    found = F.array_sort(F.array_distinct(years(text)))
    return F.when(F.lower(_text(text)).rlike(COMPARING) & (F.size(found) >= 2), found).otherwise(F.array().cast("array<int>"))


def forms(text: Column) -> Column:
    numbered = F.transform(F.regexp_extract_all(_text(text), F.lit(FORM), F.lit(1)), lambda x: F.concat(F.lit("Form"), F.replace(x, F.lit("-"))))
    lettered = F.transform(F.regexp_extract_all(_text(text), F.lit(SCHEDULE), F.lit(1)), lambda x: F.concat(F.lit("Schedule"), x))
    return F.array_sort(F.array_distinct(F.concat(numbered, lettered)))


def publications(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(_text(text), F.lit(PUBLICATION), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.rlike("^([0-9]+|[0-9]+[ab])$"))))


def topics(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The topics that a text has a word of, in the order of their names."""
    hits = [F.when(_text(text).rlike(f"(?i){p}"), F.lit(t)) for t, p in patterns or TOPICS]
    return F.array_sort(F.array_compact(F.array(*hits)))


def terms(text: Column) -> Column:
    """Lower-case words that aren't stop words, of two characters or more, repeats included."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[a-z0-9$%]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def numbers(text: Column) -> Column:
    """Distinct amounts, shares and large numbers, as written."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(_text(text), F.lit(p), F.lit(0)) for p in NUMBERS)))


def entities(text: Column) -> Column:
    """How many amounts, shares and references a text has."""
    return F.regexp_count(_text(text), F.lit(ENTITY))


def normalised(text: Column) -> Column:
    """A question without phrases that refer to an excerpt, spaces collapsed, first letter upper case; a question that would be left empty stays as it is."""
    bare = F.trim(F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, p, ""), EXCERPTS, _text(text)), r"\s{2,}", " "))
    upper = F.concat(F.upper(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2)))
    return F.when(bare == "", text).otherwise(upper)


def metadata(rows: DataFrame, text_col: str, default_year: int = DEFAULT_YEAR) -> DataFrame:
    """rows with tax_year, comparison_years, form_refs, pub_refs and topic_tags of a column of questions."""
    t = F.col(text_col)
    return rows.withColumns({"tax_year": tax_year(t, default_year), "comparison_years": comparison_years(t), "form_refs": forms(t), "pub_refs": publications(t), "topic_tags": topics(t)})


def scope(asked: DataFrame, registry: DataFrame, qid: str = "qid", least: float = 0.6, most: int = 3) -> DataFrame:
    """(qid, pubs): which publications a question is about. asked: qid, topic_tags, pub_refs, tax_year, confidence; registry: pub, topic_tags, tax_years (a dimension).

    Publications that a question with topics names are its scope. Otherwise, with enough confidence, those whose tags contain one of its topics, of its year if any are, the first by number. Questions without a scope are left out."""
    named = asked.filter((F.size("topic_tags") > 0) & (F.size("pub_refs") > 0)).select(qid, F.col("pub_refs").alias("pubs"))
    open_ones = asked.filter((F.size("topic_tags") > 0) & (F.size("pub_refs") == 0) & (F.col("confidence") >= least)).select(qid, "tax_year", F.explode("topic_tags").alias("topic"))
    tags = registry.select("pub", "tax_years", F.explode("topic_tags").alias("tag"))
    met = open_ones.join(small(tags), F.lower("tag").contains(F.lower("topic"))).groupBy(qid, "pub").agg(F.bool_or(F.coalesce(F.array_contains("tax_years", F.col("tax_year")), F.col("tax_year").isNull())).alias("fits"))
    w = Window.partitionBy(qid).orderBy(*natural("pub"))
    fitting = met.withColumn("any", F.max("fits").over(Window.partitionBy(qid))).filter("fits OR NOT any").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    listed = fitting.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "pub"))), lambda x: x.pub).alias("pubs"))
    return named.unionByName(listed)


def natural(name: str) -> tuple[Column, Column]:
    """Sort keys of names with a number: the number of their digits (none: 0), then the name."""
    return F.coalesce(F.regexp_replace(name, "[^0-9]", "").try_cast("bigint"), F.lit(0)), F.col(name)


def chunk_id(pub: Column, year: Column, index: Column) -> Column:
    """p17-2025::0004; negative indexes and those of five digits are written whole."""
    return F.format_string("p%s-%s::%04d", pub.cast("string"), year.cast("string"), index.cast("int"))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def unique_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def tokens(text: Column) -> Column:
    """The estimate of a text's tokens: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_text(text)) / 4).cast("int"))
