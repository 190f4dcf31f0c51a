"""Gold sets, rule and publication tables: filters, samples, neighbours, counts, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts as T
from lodestrata.functions.questions import natural

SEED, BUCKETS, LEAST_TOKENS, WINDOW = 42, 15, 80, 1
#: Errors before warnings before information, as their type declares them.
SEVERITY = ("ERROR", "WARNING", "INFO")


def severity(c: str = "severity") -> Column:
    """The place of a severity; unknown ones come last."""
    at = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.coalesce(c, F.lit("")))
    return F.when(at == 0, len(SEVERITY) + 1).otherwise(at).cast("int")


def seeded(id_col: str, seed: int = SEED) -> Column:
    """A sort key that shuffles ids, the same each time."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def rules_by_field(rules: DataFrame, field_path: str, year: int | None = None, level: str | None = None) -> DataFrame:
    """Rules of a field, of a year and of a severity if these are given, errors first."""
    rows = rules.filter(F.col("field_path") == field_path)
    rows = rows if year is None else rows.filter(F.col("tax_year") == year)
    return (rows if level is None else rows.filter(F.col("severity") == level)).orderBy(severity(), "rule_id")


def rules_by_form(rules: DataFrame, form: str, year: int) -> DataFrame:
    """Rules of a form and year, information first: the order of the type from its end."""
    return rules.filter((F.col("form_family") == form) & (F.col("tax_year") == year)).orderBy(severity().desc(), "rule_id")


def of_kinds(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """Chunks of some types; one without a type is detail."""
    return chunks.filter(F.coalesce("chunk_type", F.lit("detail")).isin(*kinds))


def chosen(rows: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows with one of the wanted values in each of the columns; an empty list wants all. An array column has it where any of its values is wanted."""
    for c, values in wanted.items():
        if values:
            listed = dict(rows.dtypes)[c].startswith("array")
            rows = rows.filter(F.arrays_overlap(c, F.array(*(F.lit(v) for v in values))) if listed else F.col(c).isin(*values))
    return rows


def has_kind(chunks: DataFrame, kind: str) -> bool:
    """Whether any chunk is of a type; one is looked for."""
    return not chunks.filter(F.coalesce("chunk_type", F.lit("detail")) == kind).limit(1).isEmpty()


def summary_chunks(chunks: DataFrame, pubs: list[str] | None = None, year: int | None = None, kinds: tuple[str, ...] = ("pub_summary", "section_summary")) -> DataFrame:
    """Summaries by publication, without a search: score 1, in order of publication, page and place."""
    rows = chosen(of_kinds(chunks, list(kinds)), {"pub": pubs or []})
    return (rows if year is None else rows.filter(F.col("year") == year)).withColumn("score", F.lit(1.0)).orderBy("pub", "page_start", "chunk_index")


def registry(pubs: DataFrame, category: str | None = None, tier: int | None = None, topic: str | None = None, year: int | None = None) -> DataFrame:
    """Publications (pub, category, tier, topic_tags, tax_years) that fit what is given, in the order of their numbers."""
    keep = F.lit(True)
    keep = keep if category is None else keep & (F.col("category") == category)
    keep = keep if tier is None else keep & (F.col("tier") == tier)
    keep = keep if topic is None else keep & F.exists("topic_tags", lambda t: F.contains(F.lower(t), F.lit(topic.lower())))
    keep = keep if year is None else keep & F.array_contains("tax_years", year)
    return pubs.filter(keep).orderBy(*natural("pub"))


def latest_missing(pubs: DataFrame, present: DataFrame) -> DataFrame:
    """(pub, year): the latest year of each publication that has years, where it isn't present (pub, year) yet."""
    return pubs.select("pub", F.array_max("tax_years").alias("year")).filter("year IS NOT NULL").join(present, ["pub", "year"], "left_anti")


def year_matrix(pubs: DataFrame, years: list[int]) -> DataFrame:
    """(pub, tier, one boolean for each year): which years each publication has, by tier and number."""
    return pubs.select("pub", "tier", *(F.array_contains("tax_years", y).alias(f"y{y}") for y in years)).orderBy("tier", *natural("pub"))


def of_publication(chunks: DataFrame, pubs: DataFrame, pub: str, year: int | None = None) -> DataFrame:
    """All chunks of a publication with its title, in order."""
    rows = chunks.filter(F.col("pub") == pub)
    rows = rows if year is None else rows.filter(F.col("year") == year)
    return rows.join(pubs.select("pub", "title"), "pub").orderBy("chunk_index")


def current_rules(rules: DataFrame, forms: DataFrame) -> DataFrame:
    """Rules that are current, with the title of their form where it is known."""
    return rules.filter("is_current").join(forms.select("form_type", "tax_year", F.col("title").alias("form_title")), ["form_type", "tax_year"], "left")


def latest_runs(runs: DataFrame) -> DataFrame:
    """(step, runs, passed, last_rate): how often each step ran, how often it passed, and the rate of its last run."""
    return runs.groupBy("step").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"), F.max_by("pass_rate", "run_at").alias("last_rate"))


def line_sections(parts: DataFrame, pages: DataFrame, n: int = 200) -> DataFrame:
    """Sections about a line with the form and year of their page and the beginning of their text."""
    return parts.filter("line IS NOT NULL").join(pages, "page_id").select("page_id", "form_type", "tax_year", "section_id", "line", "heading", F.left("text", F.lit(n)).alias("preview"))


def gold(entries: DataFrame, pubs: list[str] | None = None, difficulty: str | None = None, verified: bool = False) -> DataFrame:
    rows = chosen(entries, {"expected_pub": pubs or [], "difficulty": [difficulty] if difficulty else []})
    return rows.filter("verified_by IS NOT NULL") if verified else rows


def general_gold(entries: DataFrame) -> DataFrame:
    """Entries with a passage to find whose question isn't about one example or worksheet line."""
    return entries.filter(~F.coalesce(F.col("question"), F.lit("")).rlike("|".join(T.SPECIFIC)) & (F.size(F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))) > 0))


def gold_counts(entries: DataFrame) -> DataFrame:
    """(expected_pub, difficulty, all_pubs, all_difficulties, n, verified): totals by publication, by difficulty and of all, in one aggregation. all_pubs and all_difficulties tell a total from a label that is null."""
    all_of = lambda c: (F.grouping(c) == 1).alias(f"all_{ {'expected_pub': 'pubs', 'difficulty': 'difficulties'}[c] }")
    sets = entries.groupingSets([[], [F.col("expected_pub")], [F.col("difficulty")]], F.col("expected_pub"), F.col("difficulty"))
    return sets.agg(all_of("expected_pub"), all_of("difficulty"), F.count("*").alias("n"), F.count("verified_by").alias("verified"))


def bucket_sample(rows: DataFrame, group: str, order: list[str], id_col: str, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """At most n rows of each group from all over it: the rows in order are cut into buckets of max(1, rows / n), and of each the row with the least seeded hash is taken, from the first bucket on."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(*order)) - 1}).withColumn("bucket", F.expr(f"_i DIV greatest(1, _n DIV {n})")).filter(F.col("bucket") < n)
    pick = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(seeded(id_col, seed), id_col))
    return placed.withColumn("_p", pick).filter("_p = 1").drop("_n", "_i", "_p")


def sample(rows: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """n rows, the same each time: those of the least seeded hashes."""
    return rows.orderBy(seeded(id_col, seed), id_col).limit(n)


def rotated(rows: DataFrame, group: list[str], order: list[str], values: tuple[str, ...] = T.DIFFICULTIES, out: str = "difficulty") -> DataFrame:
    """rows with the values in turn, in their order within each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn(out, F.get(F.array(*(F.lit(v) for v in values)), place % len(values)))


def neighbours(rows: DataFrame, group: str, order: list[str], id_col: str, width: int = WINDOW, out: str = "neighbours") -> DataFrame:
    """rows with the ids of up to width rows before and after each in its group, itself left out."""
    w = Window.partitionBy(group).orderBy(*order)
    sides = [F.lag(id_col, k).over(w) for k in range(width, 0, -1)] + [F.lead(id_col, k).over(w) for k in range(1, width + 1)]
    return rows.withColumn(out, F.array_compact(F.array(*sides)))


def method_counts(results: DataFrame) -> DataFrame:
    """How many results of each question came by each method."""
    return results.groupBy("qid", "retrieval_method").agg(F.count("*").alias("n"))


def chunk_averages(chunks: DataFrame) -> DataFrame:
    """Chunks with the mean number of tokens of their publication."""
    return chunks.join(chunks.groupBy("pub").agg(F.avg("token_count").alias("mean_tokens")), "pub")


def annotated(chunks: DataFrame) -> DataFrame:
    """How many chunks there are, and how many with an annotation that isn't empty, a line reference and a vector."""
    return chunks.agg(F.count("*").alias("chunks"), F.count(F.nullif("context_annotation", F.lit(""))).alias("annotated"), F.count_if(F.size("line_refs") > 0).alias("with_lines"), F.count("embedding").alias("embedded"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of an array column."""
    return rows.select(F.explode(column).alias("value")).distinct()


def compressed(contexts: DataFrame, extract, least: int = 8) -> DataFrame:
    """Contexts (qid, id, pub, score, text) of questions with so many or more: those of one publication become one, its best, with what extract makes of their texts (a Column of the joined text); a publication's single context stays."""
    w, p = Window.partitionBy("qid"), Window.partitionBy("qid", "pub")
    rows = contexts.withColumns({"_n": F.count("*").over(w), "_p": F.count("*").over(p), "_r": F.row_number().over(p.orderBy(F.desc("score"), "id"))})
    many = (F.col("_n") >= least) & (F.col("_p") > 1)
    joined = rows.filter(many).groupBy("qid", "pub").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x.text), "\n\n").alias("_all"))
    made = rows.filter(many & (F.col("_r") == 1)).join(joined, ["qid", "pub"]).withColumn("text", F.coalesce(extract(F.col("_all")), F.col("text"))).drop("_all")
    return rows.filter(~many).unionByName(made).drop("_n", "_p", "_r")
