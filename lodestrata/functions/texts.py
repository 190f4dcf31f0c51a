"""Expressions over passages and answers: paragraphs, sentences, headings, key terms, context lines, facts, scores and JSON inside text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of headers and footers, headings, thresholds and references.
HEADERS = r"(?im)Publication\s+\d+\s*\(\d{4}\)|Page\s+\d+\s+of\s+\d+|Chapter\s+\d+\s+\w[\w\s]{0,30}Page\s+\d+|^\d+\s*$|^\d+\s+(?:Chapter|Part)\s+\d+"
CONTENTS, CHAPTER, PAGE_NUMBER = r"(?i)^\d+\s+(?:Chapter|Part)\s+\d+", r"(?i)^(Chapter|Part)\s+\d+[.\s]+(.+)", r"\s+\d{1,4}\s*$"
CHAPTER_HEADER = (r"(?im)Publication\s+\d+\s*\(\d{4}\)\s+Chapter\s+(\d+)\s+([\w\s\(\)&,\-/']+?)(?:\s+\d+\s*$)", r"(?im)^\d+\s+Chapter\s+(\d+)\s+([\w\s\(\)&,\-/']+?)\s+Publication\s+\d+")
THRESHOLD = r"(?i)\$[\d,]+(?:\.\d+)?|\d+(?:\.\d+)?%|(?:limit|maximum|minimum|threshold|cap|ceiling|floor)\s+(?:is|of|for)?\s*\$?[\d,]+"
AMOUNT = r"\$[\d,]+(?:\.\d+)?"
# Patterns of questions that ask about one example or line; they tell upper from lower case.
SPECIFIC = [
    r"\bExample \d+\b", r"\bexample \d+\b", r"In the .{3,40} example", r"In Example", r"in example", r"line \d+ of (the|this|your)", r"on line \d+", r"enter on line",
    r"what amount .{0,30}(enter|enters)", r"what .{0,20}(amount|figure|number).{0,20}(appears?|goes?|falls?)\b",
]
# Names under which a list of pairs may stand in a JSON object, and of difficulties.
PAIR_NAMES, DIFFICULTIES = ("pairs", "questions", "qa_pairs", "items", "results", "question_answer_pairs", "qa", "answers"), ("simple", "medium", "complex")
PAIR = "struct<question:string,ground_truth:string,difficulty:string,topic_tags:array<string>>"


def paragraphs(text: Column, least: int = 10) -> Column:
    """What blank lines part, each on one line, of more than so many characters."""
    flat = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.btrim(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(flat, lambda p: F.length(p) > least)


def sentences(text: Column) -> Column:
    """What white space after a full stop, exclamation or question mark parts."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")


def without_headers(text: Column) -> Column:
    """A page without its header, footer and page number, at most one blank line in a row."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), HEADERS, ""), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def heading(line: Column) -> Column:
    """struct(chapter, section) of a line; both null where it is no heading. Numbered chapters and parts and short lines in capitals are chapters; short lines of several words that begin upper case and end without a mark are sections."""
    t = F.btrim(F.coalesce(line, F.lit("")))
    clean = lambda c: F.btrim(F.regexp_replace(c, PAGE_NUMBER, ""))
    size = F.length(t)
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & size.between(6, 60)
    first = F.left(t, F.lit(1))
    opens = (F.upper(first) == first) & (F.lower(first) != first)
    titled = F.initcap(t) == t
    bare = clean(F.regexp_replace(t, r"^\d+\s+", ""))
    section = (titled & (F.lower(t) != F.upper(t)) | opens & ~F.substring(t, -1, 1).isin(*".?!,;:")) & size.between(6, 60) & t.contains(" ") & F.length(bare).between(6, 60) & bare.contains(" ")
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("chapter"), b.alias("section"))
    return F.when((size == 0) | (size > 120) | t.rlike(CONTENTS), pair(none, none)).when(t.rlike(CHAPTER), pair(clean(t), none)).when(capitals, pair(t, none)).when(section, pair(none, bare)).otherwise(pair(none, none))


def chapter_of_page(text: Column, lines: int = 3) -> Column:
    """struct(number, title) of the first chapter named in the first or last lines of a page; null: none."""
    all_lines = F.split(F.coalesce(text, F.lit("")), "\n")
    ends = F.concat(F.slice(all_lines, 1, lines), F.slice(all_lines, F.greatest(F.lit(1), F.size(all_lines) - lines + 1), F.lit(lines)))

    def named(line: Column) -> Column:
        hits = [F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).cast("int").alias("number"), F.btrim(F.regexp_replace(F.regexp_extract(line, p, 2), PAGE_NUMBER, "")).alias("title"))) for p in CHAPTER_HEADER]
        return F.coalesce(*hits)

    return F.get(F.filter(F.transform(ends, named), lambda x: x.isNotNull()), F.lit(0))


def key_terms(text: Column, forms: Column, most: int = 20) -> Column:
    """Distinct thresholds of a text, then its forms, in order, at most so many."""
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(THRESHOLD), F.lit(0)), lambda t: F.btrim(t)), lambda t: F.length(t) > 2)
    return F.slice(F.array_distinct(F.concat(found, F.coalesce(forms, F.array().cast("array<string>")))), 1, most)


class Enrichment:
    """Lines put before passages of some publications: where a passage has a pattern, a header and the phrases of its other patterns. A registry: register(pub, ...) adds or replaces.

    A passage of a publication without an entry gets its chapter, section and forms."""

    def __init__(self, prefix: str = "Pub") -> None:
        self.prefix, self.entries = prefix, {}

    def register(self, pub: str, gate: str, header: str, phrases: list[tuple[str, str]], separator: str = " ", always: bool = False) -> None:
        """always: the header alone will do."""
        self.entries[pub] = (gate, header, phrases, separator, always)

    def line(self, pub: Column, text: Column, chapter: Column, section: Column, forms: Column) -> Column:
        """The line for each passage; null: none."""
        text, blank = F.coalesce(text, F.lit("")), lambda c: F.nullif(c, F.lit(""))
        named = F.when(F.size(forms) > 0, F.concat(F.lit("Related forms: "), F.array_join(forms, ", ")))
        general = F.nullif(F.concat_ws(" | ", F.concat(F.lit(f"[{self.prefix} "), pub, F.lit("] "), blank(chapter)), blank(section), named), F.lit(""))
        out = general
        for name, (gate, header, phrases, separator, always) in self.entries.items():
            said = F.concat_ws(separator, *(F.when(text.rlike(f"(?i){p}"), F.lit(phrase)) for p, phrase in phrases))
            own = F.when(text.rlike(f"(?i){gate}") & (F.lit(always) | (said != "")), F.concat_ws(separator, F.lit(header), F.nullif(said, F.lit(""))))
            out = F.when(pub == name, own).otherwise(out)
        return out

    def apply(self, pub: Column, text: Column, chapter: Column, section: Column, forms: Column) -> Column:
        """The passages with their line and an empty line before them."""
        return F.concat_ws("\n\n", self.line(pub, text, chapter, section, forms), text)


def annotation(prefix: str, pub: Column, title: Column, chapter: Column, section: Column, year: Column, text: Column, signals: list[tuple[str, str]] | None = None, amounts: int = 5) -> Column:
    """A sentence that says where a passage is from and which amounts it names. signals: (pattern, what it covers)."""
    blank = lambda c: F.nullif(c, F.lit(""))
    quoted = lambda word, c: F.concat(F.lit(f"{word} '"), blank(c), F.lit("'"))
    found = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(0)), 1, amounts)
    head = F.concat(F.lit(f"This chunk from {prefix} "), pub, F.coalesce(F.concat(F.lit(" ("), blank(title), F.lit(")")), F.lit("")))
    covered = [F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){p}"), F.lit(f"— covers {what}")) for p, what in signals or []]
    said = F.concat_ws(" ", head, quoted("chapter", chapter), quoted("section", section), F.concat(F.lit("for tax year "), year.cast("string")), *covered, F.when(F.size(found) > 0, F.concat(F.lit("— mentions amounts: "), F.array_join(found, ", "))))
    return F.concat(said, F.lit("."))


def facts(answer: Column, wanted: Column) -> Column:
    """struct(found, total, ratio, missing): which facts an answer contains, whatever their case. An empty answer has none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    has = lambda f: (low != "") & F.contains(low, F.lower(f))
    n, total = F.size(F.filter(wanted, has)), F.size(wanted)
    return F.struct(n.alias("found"), total.alias("total"), F.when(total > 0, F.round(n / total, 3)).otherwise(0.0).alias("ratio"), F.filter(wanted, lambda f: ~has(f)).alias("missing"))


def clamped(score: Column, most: int = 4) -> Column:
    """A whole number as a judge's score between 0 and most; null for anything else."""
    return F.greatest(F.lit(0), F.least(F.lit(most), score.cast("string").try_cast("int")))


def passes(overall: Column, dimensions: list[Column], least: float = 3.0, each: int = 3, needed: int = 2) -> Column:
    """Whether a judged answer is good: overall and in at least so many dimensions."""
    high = reduce(lambda a, b: a + b, (F.coalesce((d >= each).cast("int"), F.lit(0)) for d in dimensions))
    return F.coalesce(overall >= least, F.lit(False)) & (high >= needed)


def json_in(text: Column) -> Column:
    """The first JSON array of a text, or else the first object, as text; null: none that can be read. Marks of a code block are passed over. What follows the JSON may be other text without the closing bracket."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*```.*$", "")
    spans = [F.regexp_extract(bare, p, 0) for p in (r"(?s)\[.*\]", r"(?s)\{.*\}")]
    return F.coalesce(*(F.when((s != "") & F.try_parse_json(s).isNotNull(), s) for s in spans))


def pairs_in(text: Column, target: Column | None = None) -> Column:
    """Questions and answers in a text that holds JSON: a list of them, an object with such a list under one of PAIR_NAMES, or one alone. Those of fewer than 20 characters are left out; an unknown difficulty becomes the target."""
    found = json_in(text)
    under = F.coalesce(*(F.get_json_object(found, f"$.{n}") for n in PAIR_NAMES))
    listed = F.when(found.startswith("["), found).when(under.isNotNull(), under).otherwise(F.concat(F.lit("["), found, F.lit("]")))
    rows = F.from_json(listed, f"array<{PAIR}>")
    tidy = F.transform(rows, lambda r: F.struct(
        F.btrim(F.coalesce(r["question"], F.lit(""))).alias("question"), F.btrim(F.coalesce(r["ground_truth"], F.lit(""))).alias("ground_truth"),
        F.when(F.btrim(r["difficulty"]).isin(*DIFFICULTIES), F.btrim(r["difficulty"])).otherwise(F.lit(DIFFICULTIES[0]) if target is None else target).alias("difficulty"), r["topic_tags"].alias("topic_tags"),
    ))
    return F.coalesce(F.filter(tidy, lambda r: (F.length(r["question"]) >= 20) & (F.length(r["ground_truth"]) >= 20)), F.array().cast(f"array<{PAIR}>"))


def completed(prompt: Column, complete: Callable[[str], str | None], fallback: Column) -> Column:
    """What a client answers to each prompt, in batches of Arrow; the fallback where it fails or answers nothing."""
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            out = []
            for p in array.to_pylist():
                try:
                    out.append(complete(p) if p is not None else None)
                except Exception:
                    out.append(None)
            yield pa.array(out, pa.string())

    return F.coalesce(F.nullif(F.arrow_udf(each, "string").asNondeterministic()(prompt), F.lit("")), fallback)
