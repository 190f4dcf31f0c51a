"""From rankings to the contexts of an answer: composite scores, scopes, retrieval in stages, budgets and citations.

Every function takes all questions at once: rows carry a qid, and what the question says (its terms, its year) is a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import classify
from lodestrata.functions import questions as Q

from .retrieval import augment, bm25, cap_and_backfill, interleave, small, top, vector_topk, vector_topk_by_facet
from .stored import stored

NAV_PUBS, NAV_SECTIONS, SUMMARY_PUBS, GUARANTEE, GUARANTEE_SCORE, PREPENDED = 6, 8, 3, 3, 0.5, 2
TOPICS, TOPIC_PUBS, GROUP_TOPICS, GROUP_PUBS, GROUPS = 7, 10, 5, 3, 4
RULES, SECTIONS, EXTRAS, BUDGET, SNIPPET, PREFIX, RERANKED = 3, 3, 3, 12_000, 200, 200, 30
SUMMARIES = ("pub_summary", "section_summary")
# Weights of the composite score.
WEIGHTS = {"score": 0.15, "terms": 0.30, "numbers": 0.15, "priority": 0.15, "kind": 0.10, "titles": 0.15}


def _share(terms: Column, text: Column) -> Column:
    """The share of terms that a lower-case text contains; 0 without terms."""
    met = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return F.when(F.size(terms) > 0, met / F.size(terms)).otherwise(0.0)


def composite(rows: DataFrame, nav: Column, added: Column, titles: tuple[str, ...] = ("chapter", "section")) -> DataFrame:
    """rows (qid, terms, wanted, text, score, pub, chunk_type and the titles) with composite. terms and wanted are questions.terms and questions.numbers of the question.

    nav and added: whether the row's publication was navigated to, or added by topics."""
    low = F.lower(F.coalesce("text", F.lit("")))
    figures = F.least(F.size(F.array_intersect("wanted", Q.numbers(F.col("text")))) / F.size("wanted"), F.lit(1.0))
    figures = F.when(F.size("wanted") > 0, figures).otherwise(F.least(Q.entities(F.col("text")) / 10.0, F.lit(0.5)))
    detailed = F.max((F.col("chunk_type") == "detail").cast("int")).over(Window.partitionBy("qid", "pub")) == 1
    kind = F.when(F.col("chunk_type") == "detail", 1.0).when(F.col("chunk_type") == "section_summary", F.when(detailed, 0.4).otherwise(0.8)).otherwise(F.when(detailed, 0.2).otherwise(0.6))
    named = [_share(F.col("terms"), F.lower(F.coalesce(t, F.lit("")))) for t in titles]
    parts = {
        "score": F.least(F.col("score").cast("double"), F.lit(1.0)), "terms": _share(F.col("terms"), low), "numbers": figures,
        "priority": F.when(nav, 1.0).when(added, 0.6).otherwise(0.3), "kind": kind, "titles": F.greatest(F.lit(0.0), F.lit(0.0), *named),
    }
    return rows.withColumn("composite", F.round(reduce(lambda a, b: a + b, (w * parts[n] for n, w in WEIGHTS.items())), 9))


def by_composite(rows: DataFrame) -> DataFrame:
    """rows with rank anew by composite, ties by the rank before."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("composite"), "rank", "id")))


def distinct_prefix(rows: DataFrame, order: list[Column | str], text: str = "text", n: int = PREFIX) -> DataFrame:
    """The first row of each question among those whose texts begin alike."""
    w = Window.partitionBy("qid", F.left(text, F.lit(n))).orderBy(*order)
    return rows.withColumn("seen", F.row_number().over(w)).filter("seen = 1").drop("seen")


def best(rows: DataFrame, k: int, order: list[Column | str]) -> DataFrame:
    """The first k rows of each question, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= k)


def in_stages(stages: list[tuple[DataFrame, int | None]], columns: list[str]) -> DataFrame:
    """One list a question of several: those of the first stage by rank, then those of the next that are not there yet, and so on; of each stage at most so many rows. place runs from 1."""
    capped = [(d.select("qid", "id", "rank", *columns) if cap is None else best(d.select("qid", "id", "rank", *columns), cap, ["rank", "id"])).withColumn("stage", F.lit(i)) for i, (d, cap) in enumerate(stages)]
    rows = reduce(DataFrame.unionByName, capped)
    first = rows.withColumn("seen", F.row_number().over(Window.partitionBy("qid", "id").orderBy("stage", "rank"))).filter("seen = 1").drop("seen")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("stage", "rank", "id")))


def within_budget(rows: DataFrame, length: Column, budget: int = BUDGET, order: str = "rank") -> DataFrame:
    """Rows of each question up to the first that would bring the running length over the budget."""
    w = Window.partitionBy("qid").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(length).over(w)).withColumn("over", F.max((F.col("running") > budget).cast("int")).over(w)).filter("over = 0").drop("over")


def citation(prefix: str, pub: Column, chapter: Column, section: Column, page: Column) -> Column:
    """prefix and publication, then chapter or else section, then the page if there is one (not 0), parted by dashes."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" — ", F.concat(F.lit(prefix), pub), F.coalesce(blank(chapter), blank(section)), F.when(page != 0, F.concat(F.lit("p. "), page.cast("string"))))


def snippet(text: Column, n: int = SNIPPET) -> Column:
    flat = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.left(flat, F.lit(n)), F.when(F.length(flat) > n, "…").otherwise(""))


def sources(rows: DataFrame, cited: str = "citation") -> DataFrame:
    """(qid, citation, place): each citation of a question once, in order of first rank."""
    first = rows.groupBy("qid", cited).agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first", cited))).drop("first")


def prompt(rows: DataFrame, head: Column, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(qid, block, n): numbered entries of head and text, of each question up to the budget. The budget bounds what is gathered."""
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), head, F.lit("\n"), F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), F.lit("\n"))
    kept = within_budget(rows.withColumn("entry", entry), F.length("entry"), budget)
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x.entry), "\n").alias("block"), F.count("*").alias("n"))


def navigate(queries: DataFrame, chunks: DataFrame, k: int = NAV_SECTIONS + 2) -> DataFrame:
    """(qid, pub, chapter, rank): the summaries nearest to each question, of its year where it has one (a question of whose year there is none looks at all years).

    queries: qid, qvec, year; chunks: id, vec, pub, year, chunk_type, chapter."""
    summaries = chunks.filter(F.col("chunk_type").isin(*SUMMARIES)).select("id", "vec", "pub", "chapter", "year")
    dated = stored(vector_topk(queries.filter("year IS NOT NULL").select("qid", "qvec", F.col("year").cast("int")), summaries.select("id", "vec", F.col("year").cast("int")), k, "year"))
    open_ones = queries.join(dated.select("qid").distinct(), "qid", "left_anti").select("qid", "qvec")
    found = dated.unionByName(vector_topk(open_ones, summaries.select("id", "vec"), k))
    return found.join(summaries.select("id", "pub", "chapter"), "id").select("qid", "pub", "chapter", "rank")


def first_pubs(found: DataFrame, most: int) -> DataFrame:
    """(qid, pub, rank): the distinct publications of a ranking in order, at most so many."""
    first = found.groupBy("qid", "pub").agg(F.min("rank").alias("first"))
    return best(first, most, ["first", "pub"]).drop("first")


def topic_pubs(asked: DataFrame, ontology: DataFrame, scoped: DataFrame, topics: int = TOPICS, most: int = TOPIC_PUBS) -> DataFrame:
    """(qid, pub, rank): publications of the first topics of each question that are not in its scope yet. asked: qid, topics (in order); ontology: topic, pub, ord (a dimension)."""
    of_topic = small(ontology.filter("topic IS NOT NULL").groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("ord", "pub"))).alias("pubs")))
    entry = f"array<struct<at:int,ord:{ontology.schema['ord'].dataType.simpleString()},pub:{ontology.schema['pub'].dataType.simpleString()}>>"
    rows = asked.select("qid", "topics", F.array().cast(entry).alias("listed"))
    for i in range(topics):  # a question's publications stand in its row, by topic and then by order, so only one row a question is shuffled
        at = F.lit(i)
        own = of_topic.select(F.col("topic").alias("_topic"), F.transform("pubs", lambda x: F.struct(at.alias("at"), x.ord.alias("ord"), x.pub.alias("pub"))).cast(entry).alias("_pubs"))  # noqa: B023
        rows = rows.join(own, F.get("topics", at) == F.col("_topic"), "left").select("qid", "topics", F.concat("listed", F.coalesce("_pubs", F.array().cast(entry))).alias("listed"))
    taken = scoped.select("qid", F.lit(None).cast(entry).alias("listed"), F.col("pub").cast(ontology.schema["pub"].dataType).alias("pub"))
    both = rows.select("qid", "listed", F.lit(None).cast(ontology.schema["pub"].dataType).alias("pub")).unionByName(taken).groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list("listed"))).alias("listed"), F.collect_set("pub").alias("taken"))
    left = F.array_except(F.transform("listed", lambda x: x.pub), F.when(F.col("qid").isNotNull(), F.col("taken")).otherwise(F.array()))  # distinct, in order
    return both.select("qid", F.posexplode(F.slice(left, 1, most)).alias("at", "pub")).select("qid", "pub", (F.col("at") + 1).alias("rank"))


def topic_groups(asked: DataFrame, ontology: DataFrame) -> DataFrame:
    """(qid, group, pub): the publications of each of the first topics that no earlier topic has, at most GROUP_PUBS of each, at most GROUPS groups; questions with fewer than two groups have none."""
    placed = asked.select("qid", F.posexplode(F.slice("topics", 1, GROUP_TOPICS)).alias("at", "topic")).join(small(ontology), "topic")
    first = placed.groupBy("qid", "pub").agg(F.min(F.struct("at", "ord")).alias("first")).select("qid", "pub", "first.*")
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("qid", "at").orderBy("ord", "pub"))).filter(F.col("n") <= GROUP_PUBS)
    ranked = few.withColumn("group", F.dense_rank().over(Window.partitionBy("qid").orderBy("at"))).filter(F.col("group") <= GROUPS)
    return ranked.withColumn("groups", F.max("group").over(Window.partitionBy("qid"))).filter("groups > 1").select("qid", "group", "groups", "pub")


def scoped_topk(queries: DataFrame, chunks: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """(qid, group, id, score, rank): of each group of a question its max(2, k / groups) nearest chunks. scope: qid, group, groups, pub; one pass over the chunks."""
    found = vector_topk_by_facet(queries.select("qid", "qvec"), chunks.select("id", "vec", F.col("pub").cast("string").alias("pub")), k, "pub", scope)
    rows = found.join(scope.withColumn("pub", F.col("pub").cast("string")), ["qid", "pub"])
    w = Window.partitionBy("qid", "group").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.greatest(F.lit(2), F.expr(f"{k} DIV groups"))).select("qid", "group", "pub", "id", "score", "rank")


def across_years(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, year, id, score, rank): of each year that a question compares its max(2, k / years) nearest chunks. queries: qid, qvec, years."""
    scope = queries.select("qid", F.explode("years").alias("group"), F.size("years").alias("groups")).withColumn("pub", F.col("group"))
    return scoped_topk(queries, chunks.select("id", "vec", F.col("year").alias("pub")), scope, k).withColumnRenamed("group", "year").drop("pub")


def scope_of(queries: DataFrame, chunks: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
    """(qid, pub, rank, added): the first NAV_PUBS publications that each question is navigated to, and after them those that its topics add (added). Tables as retrieve has them."""
    pub = F.col("pub").cast("string")
    chunks = chunks.withColumn("pub", pub)
    scope = stored(first_pubs(navigate(queries, chunks), NAV_PUBS).withColumn("added", F.lit(False)))
    if ontology is None:
        return scope
    more = topic_pubs(queries, ontology.withColumn("pub", pub), scope).select("qid", "pub", (F.col("rank") + NAV_PUBS).alias("rank"), F.lit(True).alias("added"))
    return stored(scope.unionByName(more))


def retrieve(queries: DataFrame, chunks: DataFrame, ontology: DataFrame | None = None, k: int = 10, default_year: int = Q.DEFAULT_YEAR, scope: DataFrame | None = None) -> DataFrame:
    """(qid, mode, stage, place, id, pub, score): the contexts of each question by navigating to publications and drilling into them.

    queries: qid, qvec, year (may be null), topics (may be empty); chunks: id, vec, pub, year, chunk_type, chapter. Stages, in order of place:
    0 at most two summaries of the scope, 1 the nearest chunks of the scope in the question's year (a later year than the default: in all years),
    2 of publications that have none in that year, their nearest in any, 3 for publications still without a context their summaries, or else chunks.
    The scope is that of scope_of, unless given; it travels with the question, so no chunk outside it is scored. Questions whose navigation finds nothing search all chunks (flat_fallback)."""
    pub = F.col("pub").cast("string")
    chunks = chunks.withColumn("pub", pub)
    queries = stored(queries)
    scope = (scope_of(queries, chunks, ontology) if scope is None else scope).select("qid", "pub", "rank")
    drilled = queries.withColumn("year", F.when(F.col("year") <= default_year, F.col("year")))
    by_place = vector_topk_by_facet(queries.select("qid", "qvec"), chunks.select("id", "vec", "pub", F.concat_ws("@", "pub", F.col("year").cast("string")).alias("at")), max(5, k), "at", scope, "pub").join(chunks.select("id", "pub", F.col("year").alias("chunk_year")), "id")
    scoped = stored(by_place.join(scope.select("qid", "pub"), ["qid", "pub"], "left_semi").join(drilled.select("qid", "year"), "qid"))
    same = F.col("year").isNull() | F.col("year").eqNullSafe(F.col("chunk_year"))
    main = best(scoped.filter(same), k, [F.desc("score"), "id"])
    having = main.select("qid", "pub").distinct()
    late = scoped.join(queries.filter("year IS NOT NULL").select("qid"), "qid", "left_semi").join(having, ["qid", "pub"], "left_anti")
    backfill = best(late, max(5, k), [F.desc("score"), "id"])
    absent = scope.select("qid", "pub").join(having.unionByName(backfill.select("qid", "pub")).distinct(), ["qid", "pub"], "left_anti")
    order = F.when(F.col("chunk_type") == SUMMARIES[0], 0).when(F.col("chunk_type") == SUMMARIES[1], 1).otherwise(2)
    lead = chunks.withColumn("n", F.row_number().over(Window.partitionBy("pub").orderBy(order, "id"))).withColumn("kind", order).filter(F.col("n") <= GUARANTEE)
    whole = lead.withColumn("best_kind", F.min(F.when(F.col("kind") < 2, 0).otherwise(1)).over(Window.partitionBy("pub"))).filter((F.col("best_kind") == 1) | (F.col("kind") < 2))
    sure = best(absent.join(whole.select("pub", "id", "kind"), "pub"), 1 << 30, ["pub", "kind", "id"]).withColumn("score", F.lit(GUARANTEE_SCORE))
    summaries = chunks.filter(F.col("chunk_type").isin(*SUMMARIES)).select("id", "vec", "pub")
    near = vector_topk_by_facet(queries.select("qid", "qvec"), summaries, SUMMARY_PUBS, "pub", scope)
    main, backfill, sure = stored(main), stored(backfill), stored(sure)
    details = main.select("qid", "id").unionByName(backfill.select("qid", "id")).unionByName(sure.select("qid", "id"))
    heads = best(near, SUMMARY_PUBS, [F.desc("score"), "id"]).join(details, ["qid", "id"], "left_anti").join(details.select("qid").distinct(), "qid", "left_semi")
    listed = in_stages([(best(heads, PREPENDED, ["rank", "id"]), None), (main, None), (backfill, None), (sure, None)], ["pub", "score"])
    lost = queries.join(scope.select("qid").distinct(), "qid", "left_anti")
    flat = vector_topk(lost.select("qid", "qvec"), chunks.select("id", "vec"), k).join(chunks.select("id", "pub"), "id")
    flat = flat.select("qid", F.lit("flat_fallback").alias("mode"), F.lit(1).alias("stage"), F.col("rank").alias("place"), "id", "pub", "score")
    return listed.select("qid", F.lit("hierarchical").alias("mode"), "stage", "place", "id", "pub", "score").unionByName(flat)


def rules_for(asked: DataFrame, rules: DataFrame, most: int = RULES, patterns: int = 3) -> DataFrame:
    """(qid, id, rank, score, text): rules whose path has one of the forms of a question, or whose error code begins as the one that it names. Errors score 1, others 0.8.

    asked: qid, form_refs, code, year; rules (a dimension): rule_id, field_path, error_code, severity, rule_text, year."""
    named = asked.select("qid", "code", "year", F.transform(F.slice("form_refs", 1, patterns), lambda f: F.replace(f, F.lit("Form"), F.lit("IRS"))).alias("paths"))
    dimension = small(rules.withColumnRenamed("year", "rule_year"))
    by_form = F.exists("paths", lambda p: F.col("field_path").contains(p)) & (F.col("year").isNull() | (F.col("year") == F.col("rule_year")))
    met = named.join(dimension, by_form | F.startswith("error_code", F.nullif("code", F.lit(""))))
    rows = met.select("qid", F.col("rule_id").alias("id"), F.when(F.col("severity") == "ERROR", 1.0).otherwise(0.8).alias("score"), F.format_string("[%s] %s: %s", "severity", "rule_id", "rule_text").alias("text"), _severity("severity").alias("order"))
    return best(rows.distinct(), most, ["order", "id"]).drop("order")


def _severity(c: Column | str) -> Column:
    """Errors before warnings before the rest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "ERROR", 0).when(c == "WARNING", 1).otherwise(2)


def sections_for(asked: DataFrame, sections: DataFrame, most: int = SECTIONS) -> DataFrame:
    """(qid, id, rank, score): sections about a line that a question names. asked: qid, lines; sections: id, line."""
    lines = asked.select("qid", F.explode("lines").alias("line")).distinct()
    return best(sections.select("id", "line").join(small(lines), "line").select("qid", "id").distinct().withColumn("score", F.lit(0.9)), most, ["id"])


def search(asked: DataFrame, chunks: DataFrame, rules: DataFrame | None = None, sections: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(qid, stage, place, id, score): rules and sections that a question names, at most RULES and SECTIONS of them, then its nearest chunks with at most EXTRAS that only its words find.

    asked: qid, text, qvec; chunks: id, vec, text, pub; rules and sections as rules_for and sections_for have them. Ids are texts, as they come from different tables."""
    meta = asked.select("qid", "qvec", "text", Q.tax_year(F.col("text")).alias("year"), Q.forms(F.col("text")).alias("form_refs"), F.regexp_extract(F.coalesce("text", F.lit("")), Q.ERROR_CODE, 0).alias("code"))
    pubs = chunks.select("id", "pub")
    main = vector_topk(meta.select("qid", "qvec"), chunks.select("id", "vec"), k).join(pubs, "id")
    found = bm25(meta.select("qid", "text"), chunks.select("id", "text"), k)
    worded = top(found.select("qid", "id", (F.col("score") / (F.col("score") + 1)).alias("score")), k).join(pubs, "id")
    merged = augment(main, worded, "pub", EXTRAS)
    stages = [(rules_for(meta, rules), RULES)] if rules is not None else []
    if sections is not None:
        lines = meta.select("qid", F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)\blines?\s+(\d+[a-z]?)"), F.lit(1)), lambda x: F.lower(x)).alias("lines"))
        stages.append((sections_for(lines, sections), SECTIONS))
    named = [(d.select("qid", F.col("id").cast("string").alias("id"), "rank", "score"), cap) for d, cap in [*stages, (merged, k + EXTRAS)]]
    return in_stages(named, ["score"]).select("qid", "stage", "place", "id", "score")


def contexts(asked: DataFrame, chunks: DataFrame, ontology: DataFrame, k: int = 10, most: int = RERANKED) -> DataFrame:
    """(qid, mode, id, pub, composite, place): the contexts of each question, ready for an answer: best first and last.

    asked: qid, text, qvec, topics; chunks: id, vec, text, pub, year, chunk_type, chapter, section. Questions that compare years look at each year (cross_year), scenarios
    of several topics at each topic's publications (scoped), all others go through retrieve. Then texts that begin alike count once, composite scores rank, and no publication has too many."""
    words_of = {"terms": Q.terms(F.col("text")), "wanted": Q.numbers(F.col("text")), "years": Q.comparison_years(F.col("text")), "year": Q.tax_year(F.col("text")), "scenario": classify.intent(F.col("text")).intent == "scenario"}
    meta = stored(asked.withColumns(words_of).withColumn("pick", F.when(F.size("years") > 1, "cross_year").when(F.col("scenario"), "scoped").otherwise("open")))
    compared, scenes = meta.filter("pick = 'cross_year'"), meta.filter("pick = 'scoped'")
    groups = stored(topic_groups(scenes, ontology))
    rest = meta.filter("pick <> 'cross_year'").join(groups.select("qid").distinct(), "qid", "left_anti")
    open_chunks, open_queries = chunks.select("id", "vec", "pub", "year", "chunk_type", "chapter"), stored(rest.select("qid", "qvec", "year", "topics"))
    scope = scope_of(open_queries, open_chunks, ontology)
    open_ones = retrieve(open_queries, open_chunks, ontology, k, scope=scope)
    by_year = across_years(compared.select("qid", "qvec", "years"), chunks.select("id", "vec", "year"), k)
    by_group = scoped_topk(scenes.select("qid", "qvec"), chunks.select("id", "vec", "pub"), groups, k)
    ordered = lambda d, mode, *keys: best(d, 1 << 30, [*keys]).select("qid", "id", "score", "rank", F.lit(mode).alias("mode"))
    found = ordered(by_year, "cross_year", "year", "rank").unionByName(ordered(by_group, "scoped", F.desc("score"), "id")).unionByName(open_ones.select("qid", "id", "score", F.col("place").cast("int").alias("rank"), "mode"))
    rows = distinct_prefix(found.join(chunks.select("id", "text", F.col("pub").cast("string").alias("pub"), "chunk_type", "chapter", "section"), "id"), ["rank", "id"])
    placed = scope.select("qid", "pub", (~F.col("added")).alias("nav"), "added").unionByName(groups.select("qid", F.col("pub").cast("string").alias("pub"), F.lit(False).alias("nav"), F.lit(True).alias("added")))
    scored = composite(rows.join(meta.select("qid", "terms", "wanted"), "qid").join(placed, ["qid", "pub"], "left"), F.coalesce("nav", F.lit(False)), F.coalesce("added", F.lit(False)))
    kept = cap_and_backfill(by_composite(scored), "pub", most).withColumn("rank", F.col("place"))
    return interleave(kept).select("qid", "mode", "id", "pub", "composite", "place")
