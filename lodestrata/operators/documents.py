"""Publications from pages of text, and instructions from sections: chapters, headings, chunks, line references, graph edges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import classify
from lodestrata.functions import questions as Q
from lodestrata.functions import texts as T

from . import chunking, knowledge
from .stored import stored

SUMMARY_TOKENS, CHAPTER_TOKENS, SUMMARY, GENERAL = 500, 350, "(Publication Summary)", "(General)"


def chapter_ranges(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(doc, number, title, first_page, last_page): chapters as the headers of pages name them; a chapter has the title of its first page."""
    named = pages.select(doc, F.col(page).alias("page"), T.chapter_of_page(F.col(text)).alias("c")).filter("c IS NOT NULL")
    found = named.groupBy(doc, F.col("c.number").alias("number")).agg(F.min_by("c.title", "page").alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return found.withColumn("title", F.concat(F.lit("Chapter "), F.col("number").cast("string"), F.lit(". "), F.col("title")))


def first_range(rows: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, order: str, value: str) -> DataFrame:
    """rows with value of the first range (in order, then by value) of their key that holds at; null where none does.

    Whole numbers. Each range is parted into the largest aligned blocks of 1, 2, 4, ... numbers that it is made of, two of a size at most, and a place is looked up as the block of each of
    the sizes that occur (63 at most): an equality join on (key, size, block), whose rows are the ranges that do hold the place. Of those the first is kept by an aggregation; no list of ranges is gathered and none is compared
    in vain."""
    row = "_row"
    numbered = stored(rows.withColumn(row, F.monotonically_increasing_id()))
    own = ranges.filter(F.col(key).isNotNull() & (F.col(low) <= F.col(high))).select(F.col(key).alias("_key"), F.col(low).cast("bigint").alias("_l"), F.col(high).cast("bigint").alias("_h"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_r"))
    blocks = stored(own.select("_key", "_r", F.explode(_dyadic(F.col("_l"), F.col("_h"))).alias("_b")).select("_key", "_r", "_b.size", "_b.block"))
    sizes = sorted(r["size"] for r in blocks.select("size").distinct().collect())  # 63 at most
    place = F.col(at).cast("bigint")
    asked = numbered.filter(place.isNotNull()).select(row, F.col(key).alias("_key"), F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.shiftright(place, s).alias("block")) for s in sizes)).cast("array<struct<size:int,block:bigint>>")).alias("_b")).select(row, "_key", "_b.size", "_b.block")
    found = asked.join(blocks, ["_key", "size", "block"]).groupBy(row).agg(F.min("_r").alias("_r"))
    return numbered.join(found, row, "left").withColumn(value, F.col("_r.v")).drop(row, "_r")


def _dyadic(low: Column, high: Column) -> Column:
    """array<struct<size, block>>: the blocks [block * 2^size, (block + 1) * 2^size) that low..high is made of. Going up through the sizes, what doesn't fill a block of the next size on either side is split off."""
    step = lambda s, i: F.struct(
        F.when(s["l"] <= s["h"], F.shiftright(s["l"] + 1, 1)).otherwise(s["l"]).alias("l"),
        F.when(s["l"] <= s["h"], F.shiftright(s["h"] + 1, 1) - 1).otherwise(s["h"]).alias("h"),
        F.when(
            s["l"] <= s["h"],
            F.concat(
                s["out"],
                F.when(s["l"] % 2 != 0, F.array(F.struct(i.alias("size"), s["l"].alias("block")))).otherwise(_NO_BLOCKS()),
                F.when((s["h"] % 2 == 0) & ((s["l"] % 2 == 0) | (s["h"] > s["l"])), F.array(F.struct(i.alias("size"), s["h"].alias("block")))).otherwise(_NO_BLOCKS()),
            ),
        ).otherwise(s["out"]).alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.struct(low.alias("l"), high.alias("h"), _NO_BLOCKS().alias("out")), step, lambda s: s["out"])


def _NO_BLOCKS() -> Column:
    return F.array().cast("array<struct<size:int,block:bigint>>")


def lines(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(doc, page, at, line, chapter, section): lines of pages in their order, with the chapter or section that the line itself names."""
    rows = pages.select(doc, F.col(page).alias("page"), F.posexplode(F.split(T.without_headers(F.col(text)), "\n")).alias("at", "line")).withColumn("h", T.heading(F.col("line")))
    return rows.select(doc, "page", "at", "line", "h.chapter", "h.section")


def walk(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text", target: int = chunking.TARGET, overlap: int = chunking.OVERLAP, hard: int = chunking.HARD, count: chunking.Counter = chunking.quarter, ranges: DataFrame | None = None) -> DataFrame:
    """(doc, chunk_index, chapter, section, page_start, page_end, text, token_count, form_refs, line_refs): what stands under one heading is packed into chunks, and no chunk goes over a heading. Pages are those on which
    the chunk's first and last words stand. ranges, as chapter_ranges has them: the chapter of a chunk under no heading of a chapter is that of its first page."""
    made = chunking.walked(lines(pages, doc, page, text), doc, 10, target, overlap, hard, count)
    if ranges is not None:
        placed = first_range(made, ranges.withColumn("_title", F.col("title")), doc, "page_start", "first_page", "last_page", "number", "_title")
        made = placed.withColumn("chapter", F.coalesce("chapter", "_title")).drop("_title")
    refs = classify.references(F.col("text"))
    return made.select(
        doc, "chunk_index", "chapter", "section", "page_start", "page_end", "text", "token_count",
        F.array_distinct(F.concat(F.transform(refs["forms"], lambda x: F.concat(F.lit("Form"), x)), F.transform(refs["schedules"], lambda x: F.concat(F.lit("Schedule"), x)))).alias("form_refs"),
        F.array_distinct(F.transform(refs["lines"], F.lower)).alias("line_refs"),
    )


def inferred_chapters(chunks: DataFrame, pub: str, order: str, page: str, text: str = "text") -> DataFrame:
    """(pub, part, first_page, last_page, n): ranges of pages for publications without chapters, each of max(20, a sixth) chunks where there are more than 30; else one range."""
    w = Window.partitionBy(pub)
    size = F.when(F.col("n") > 30, F.greatest(F.lit(20), F.expr("n DIV 6"))).otherwise(F.col("n"))
    placed = chunks.select(pub, page, F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy(order)) - 1).alias("i")).withColumn("size", size)
    return placed.groupBy(pub, F.expr("i DIV size").alias("part")).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n"))


# Fixed value: a chapter's number and title on a line of a text.
CHAPTER_IN_TEXT = r"(?im)(?:^|\n)\s*(?:\d+\s+)?Chapter\s+(\d+)[\.\s]+([\w\s\(\)&,\-/']+?)(?:\s+Publication|\s*$)"
INTRODUCTION = "Introduction"


def named_chapters(chunks: DataFrame) -> DataFrame:
    """(pub, page, label) of chunks (pub, chunk_index, page_start, text): pages on which a chapter begins, as the texts name chapters. Of the references on a page the last that is the first one to its chapter counts,
    or else the first at all."""
    met = F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CHAPTER_IN_TEXT), F.lit(0))).alias("pos", "m")
    part = lambda i: F.regexp_extract("m", CHAPTER_IN_TEXT, i)
    refs = chunks.select("pub", F.col("page_start").alias("page"), F.col("chunk_index").alias("i"), met).select("pub", "page", F.struct("i", "pos").alias("at"), part(1).cast("int").alias("number"), F.btrim(part(2), F.lit(" \t\n\r")).alias("title"))
    opens = F.row_number().over(Window.partitionBy("pub", "number").orderBy("at")) == 1
    label = F.concat(F.lit("Chapter "), F.col("number").cast("string"), F.lit(". "), F.col("title"))
    marked = refs.withColumns({"opens": opens, "label": label})
    pick = F.coalesce(F.max_by("label", F.when(F.col("opens"), F.col("at"))), F.min_by("label", "at"))
    return marked.groupBy("pub", "page").agg(pick.alias("label"))


def with_chapters(chunks: DataFrame) -> DataFrame:
    """chunks (pub, chunk_index, page_start, page_end, text, chapter and others) where the chunks of publications that have no chapter at all are placed in chapters that their texts name, by page: those before the first are
    the introduction. Where fewer than two pages or groups are found, publications of more than 30 chunks are parted into ranges of pages of max(20, a sixth) chunks, and smaller ones are of one general chapter."""
    titled = chunks.groupBy("pub").agg(F.max(F.coalesce(F.col("chapter") != "", F.lit(False))).alias("_titled"))
    rows = stored(chunks.join(titled, "pub"))
    bare = rows.filter("NOT _titled")
    starts = named_chapters(bare).withColumn("last", F.lead("page").over(Window.partitionBy("pub").orderBy("page")) - 1)
    starts = stored(starts.withColumn("pages", F.count("*").over(Window.partitionBy("pub"))).filter("pages > 1").withColumn("last", F.coalesce("last", F.lit((1 << 31) - 1))))
    placed = first_range(bare.join(starts.select("pub").distinct(), "pub", "left_semi"), starts.withColumnRenamed("label", "_label"), "pub", "page_start", "page", "last", "page", "_label")
    placed = placed.withColumn("_label", F.coalesce("_label", F.lit(INTRODUCTION)))
    whole = F.min("_label").over(Window.partitionBy("pub")) != F.max("_label").over(Window.partitionBy("pub"))
    placed = stored(placed.withColumn("_good", whole).filter("_good"))
    rest = bare.join(placed.select("pub").distinct(), "pub", "left_anti")
    w = Window.partitionBy("pub")
    size = F.when(F.col("_n") > 30, F.greatest(F.lit(20), F.expr("_n DIV 6"))).otherwise(F.col("_n"))
    parted = rest.withColumn("_n", F.count("*").over(w)).withColumn("_part", ((F.row_number().over(w.orderBy("chunk_index")) - 1) / size).cast("int"))
    of = Window.partitionBy("pub", "_part")
    pages = F.format_string("Pages %s–%s", F.min_by("page_start", "chunk_index").over(of).cast("string"), F.max_by("page_end", "chunk_index").over(of).cast("string"))
    parted = parted.withColumn("_label", F.when(F.col("_n") > 30, pages).otherwise(F.lit(GENERAL)))
    done = [d.withColumn("chapter", F.col("_label")).select(chunks.columns) for d in (placed, parted)]
    return rows.filter("_titled").select(chunks.columns).unionByName(done[0]).unionByName(done[1])


def line_reference(heading: Column, mapped: list[str]) -> Column:
    """The line that a heading is about: of a range its end if that is mapped to fields, else its beginning; of a list the first that is mapped, else the first; null: none."""
    rest = F.regexp_extract(F.coalesce(heading, F.lit("")), r"(?is)Lines?\s+(.*)$", 1)
    first, last = (F.lower(F.regexp_extract(rest, r"(?i)^(\d+[a-z]?)\s*[–\-]\s*(\d+[a-z]?)", i)) for i in (1, 2))
    listed = F.transform(F.regexp_extract_all(rest, F.lit(r"(?i)\d+[a-z]?"), F.lit(0)), F.lower)
    known = F.array(*(F.lit(x) for x in mapped)).cast("array<string>")
    return F.when(first != "", F.when(F.array_contains(known, last), last).otherwise(first)).otherwise(F.coalesce(F.get(F.filter(listed, lambda x: F.array_contains(known, x)), F.lit(0)), F.get(listed, F.lit(0))))


def _with_kind(kind: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(kind), x))


def cross_references(text: Column) -> Column:
    """Distinct forms, schedules and publications of a text, each with its kind before it."""
    refs = classify.references(text)
    kinds = (("Form", refs["forms"]), ("Schedule", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bSchedule\s+([A-Z0-9]+)"), F.lit(1))), ("Pub", refs["pubs"]))
    return F.array_distinct(F.concat(*(_with_kind(k, c) for k, c in kinds)))


def assembled(parts: DataFrame, page_id: str, fields: DataFrame, first_level: str = "h2") -> DataFrame:
    """Sections of pages, made ready: section_id, section_type, line, field_names and cross_refs, with the heading of the first level above. fields (line, field): which fields a line fills, a dimension."""
    listed = fields.groupBy("line").agg(F.array_sort(F.collect_list("field")).alias("field_names"))
    mapped = [r["line"] for r in listed.select("line").orderBy("line").limit(10_000).collect()]
    upto = Window.partitionBy(page_id).orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.last(F.when(F.col("level") == first_level, F.col("heading")), ignorenulls=True).over(upto)
    own = F.concat(F.col(page_id).cast("string"), F.lit("::"), F.coalesce(F.nullif("anchor", F.lit("")), F.replace(F.left("heading", F.lit(40)), F.lit(" "), F.lit("_"))))
    named = parts.filter("heading <> ''").withColumn("above", above)
    rows = named.select("*", own.alias("section_id"), classify.section_type(F.col("heading"), F.col("above")).alias("section_type"), line_reference(F.col("heading"), mapped).alias("line"), cross_references(F.col("text")).alias("cross_refs"))
    return rows.join(F.broadcast(listed) if len(mapped) < 10_000 else listed, "line", "left").withColumn("field_names", F.coalesce("field_names", F.array().cast("array<string>")))


def section_edges(parts: DataFrame, page_id: str, aliases: DataFrame | None = None) -> DataFrame:
    """(src, dst, type): HAS_SECTION from pages, EXPLAINS to fields, REFERENCES_FORM to forms by their name or alias (alias, form). parts: section_id, field_names, cross_refs."""
    refs = parts.select("section_id", F.explode("cross_refs").alias("ref"))
    named = refs.join(aliases, refs["ref"] == aliases["alias"], "left").select("section_id", F.coalesce("form", "ref").alias("form")) if aliases is not None else refs.withColumnRenamed("ref", "form")
    pairs = (("HAS_SECTION", parts, page_id, "section_id"), ("EXPLAINS", parts.select("section_id", F.explode("field_names").alias("field")), "section_id", "field"), ("REFERENCES_FORM", named, "section_id", "form"))
    first, *rest = (knowledge.edges(rows, kind, a, b).select("src", "dst", F.col("type")) for kind, rows, a, b in pairs)
    for e in rest:
        first = first.unionByName(e)
    return first


def fitted(head: Column, body: Column, last: Column, tokens: int) -> Column:
    """head, as many of body's lines as fit, and last, joined by line ends: lines go from the end of body until the text has at most so many tokens."""
    room = 4 * (tokens + 1) - 1 - F.length(head) - F.length(last) - 1  # tokens are a quarter of the characters
    used = F.aggregate(body, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("full")), lambda s, x: F.when(s["full"] | (s["size"] + F.length(x) + 1 > room), F.struct(s["n"], s["size"], F.lit(True).alias("full"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["size"] + F.length(x) + 1).alias("size"), F.lit(False).alias("full"))))
    return F.concat_ws("\n", head, F.slice(body, F.lit(1), used["n"]), last)


def summaries(chunks: DataFrame, titles: DataFrame, sections_a_chapter: int = 5, chapters: int = 50, tokens: int = SUMMARY_TOKENS) -> DataFrame:
    """(pub, chunk_id, chunk_index, text, token_count, chunk_type): one anchor for each publication (pub, year, title) with its chapters, their first sections and its forms, in order of first place.

    chunks: pub, chunk_index, chapter, section, form_refs. Only distinct headings are gathered, and of those the first."""
    order = lambda *k: Window.partitionBy(*k).orderBy("at")
    sec = chunks.filter("section <> ''").groupBy("pub", F.coalesce("chapter", F.lit(GENERAL)).alias("chapter"), "section").agg(F.min("chunk_index").alias("at"))
    kept = sec.withColumn("n", F.row_number().over(order("pub", "chapter"))).filter(F.col("n") <= sections_a_chapter)
    under = kept.groupBy("pub", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: F.concat(F.lit("    - "), x.section)).alias("own"))
    ch = chunks.filter("chapter <> ''").groupBy("pub", "chapter").agg(F.min("chunk_index").alias("at")).withColumn("n", F.row_number().over(order("pub"))).filter(F.col("n") <= chapters).join(under, ["pub", "chapter"], "left")
    lines_of = F.concat(F.array(F.concat(F.lit("  - "), F.col("chapter"))), F.coalesce("own", F.array().cast("array<string>")))
    toc = ch.groupBy("pub").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", lines_of.alias("l")))), lambda x: x.l)).alias("toc"))
    forms = chunks.select("pub", F.explode("form_refs").alias("form")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("pub").orderBy("form"))).filter("n <= 10").groupBy("pub").agg(F.array_join(F.array_sort(F.collect_list("form")), ", ").alias("forms"))
    rows = titles.join(toc, "pub", "left").join(forms, "pub", "left")
    head = F.format_string("[PUBLICATION SUMMARY] Publication %s: %s (Tax Year %s)\nThis publication covers the following topics:", F.col("pub"), F.col("title"), F.col("year").cast("string"))
    last = F.concat(F.lit("Key forms and schedules: "), F.coalesce("forms", F.lit("(none)")))
    text = fitted(head, F.coalesce("toc", F.array(F.lit("(No chapter structure detected)"))), last, tokens)
    return rows.select("pub", F.format_string("p%s-%s::summary", F.col("pub"), F.col("year").cast("string")).alias("chunk_id"), F.lit(-1).alias("chunk_index"), F.lit(SUMMARY).alias("chapter"), text.alias("text"), Q.tokens(text).alias("token_count"), F.lit("pub_summary").alias("chunk_type"))


PASSAGE, OVERVIEW, LISTED, LIMITS = 150, 100, 8, 10


def chapter_summaries(chunks: DataFrame, years: DataFrame, sections_a_chapter: int = LISTED, tokens: int = CHAPTER_TOKENS) -> DataFrame:
    """As summaries, one anchor for each chapter, numbered in order from 0; negative chunk_index. years: pub, year. Under the head stand the chapter's first passage (the first words of the first of its first three chunks that
    is long enough), its first sections, forms, amounts and limits, and how many passages it has; parts go from the end until the text has at most so many tokens.

    chunks: pub, chunk_index, chapter, section, text, form_refs. Of a chapter only its first three chunks' words, and the first few distinct sections, forms and terms are gathered."""
    chapter = F.coalesce(F.nullif("chapter", F.lit("")), F.lit(GENERAL))
    rows = chunks.select("pub", chapter.alias("chapter"), "chunk_index", "section", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("form_refs", F.array().cast("array<string>")).alias("form_refs"))
    by = ["pub", "chapter"]
    groups = knowledge.chapters(chunks, "pub", "chapter", "chunk_index", GENERAL)

    def listed(items: DataFrame, order: str, most: int, name: str) -> DataFrame:
        """The first distinct items (pub, chapter, item, at) of each chapter in one line."""
        first = items.groupBy(*by, "item").agg(F.min("at").alias("at")).withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("k") <= most)
        return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x.item), ", ").alias(name))

    sec = listed(rows.filter("section <> ''").select(*by, F.col("section").alias("item"), F.col("chunk_index").alias("at")), "at", sections_a_chapter, "sections")
    forms = listed(rows.select(*by, F.explode("form_refs").alias("item"), F.col("chunk_index").alias("at")), "item", LISTED, "forms")
    found = rows.select(*by, "chunk_index", F.posexplode(T.key_terms(F.col("text"), F.col("form_refs"))).alias("pos", "item"))
    limits = listed(found.select(*by, "item", F.struct("chunk_index", "pos").alias("at")), "at", LIMITS, "limits")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    lead = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index"))).filter((F.col("k") <= 3) & (F.length("text") > OVERVIEW))
    lead = lead.groupBy(*by).agg(F.min_by("text", "k").alias("text")).select(*by, F.concat(F.array_join(F.slice(words, 1, PASSAGE), " "), F.when(F.size(words) > PASSAGE, "...").otherwise("")).alias("passage"))
    made = groups
    for side in (sec, forms, limits, lead):
        made = made.join(side, by, "left")
    made = made.join(years, "pub").withColumn("i", F.row_number().over(Window.partitionBy("pub").orderBy("first", "chapter")) - 1)
    head = F.format_string("[SECTION SUMMARY] Publication %s (Tax Year %s), %s", F.col("pub"), F.col("year").cast("string"), F.col("chapter"))
    parts = F.array_compact(F.array(head, F.col("passage"), F.concat(F.lit("Key sections: "), "sections"), F.concat(F.lit("Forms: "), "forms"), F.concat(F.lit("Amounts and limits: "), "limits"), F.format_string("%d passages.", F.col("n"))))
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "\n"))
    text = F.coalesce(F.get(F.filter(prefixes, lambda t: Q.tokens(t) <= tokens), F.lit(0)), head)
    return made.select("pub", F.format_string("p%s-%s::section_summary::%04d", F.col("pub"), F.col("year").cast("string"), F.col("i")).alias("chunk_id"), (-2 - F.col("i")).alias("chunk_index"), "chapter", text.alias("text"), Q.tokens(text).alias("token_count"), F.lit("section_summary").alias("chunk_type"))


def topic_of_chapters(parts: DataFrame, topics: DataFrame) -> DataFrame:
    """(pub, chapter, topic): topics whose chapter (of their publication) contains the chapter's name or is contained in it, whatever the case; a topic without a chapter fits all of its publication. topics: topic, pub, topic_chapter."""
    a, b = F.lower(F.coalesce("chapter", F.lit(""))), F.lower(F.coalesce("topic_chapter", F.lit("")))
    return parts.select("pub", "chapter").distinct().join(topics, "pub").filter(F.contains(a, b) | F.contains(b, a)).select("pub", "chapter", "topic").distinct()
