"""Web pages to sections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
SKIPPED = ("script", "style", "nav", "head", "footer")


TITLE = r"(?i)<title>([^<]+)</title>"


def titles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, html_hash) of web pages; without a title it is empty."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(id_col, F.trim(F.regexp_extract(html, TITLE, 1)).alias("title"), F.sha2(html, 256).alias("html_hash"))


def sections(pages: DataFrame, id_col: str, html_col: str, headings: tuple[str, ...] = ("h2", "h3", "h4")) -> DataFrame:
    """(id, sequence, level, anchor, heading, text): one row for each heading of a page and what stands before the first, with the text of the
    paragraphs under it, and above, the heading of the first level over it. All within a row of pages, without a shuffle. A null page has no sections."""
    clean = F.col(html_col)
    for tag in SKIPPED:
        clean = F.regexp_replace(clean, rf"(?is)<{tag}\b.*?</{tag}>", "")
    names = "|".join(headings)
    marked = F.regexp_replace(clean, rf"(?i)(<(?:{names})\b)", f"{MARK}$1")
    parts = pages.select(id_col, F.posexplode(F.split(marked, MARK)).alias("sequence", "part"))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[\s]+", " "))
    paragraphs = F.transform(F.regexp_extract_all("part", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip)
    head = rf"(?is)^<({names})\b[^>]*>(.*?)</(?:{names})>"
    return parts.select(
        id_col, "sequence", F.lower(F.regexp_extract("part", head, 1)).alias("level"), F.regexp_extract("part", r'(?is)^<h\d\b[^>]*\bid="([^"]*)"', 1).alias("anchor"),
        strip(F.regexp_extract("part", head, 2)).alias("heading"), F.array_join(F.filter(paragraphs, lambda p: p != ""), " ").alias("text"),
    ).filter((F.col("sequence") > 0) | (F.col("text") != ""))


# Elements without content; classes of h2 that are navigation, that open a block without instructions, and that open a section; of h4 that open a section and that belong to the one above.
HIDDEN = ("script", "style", "nav", "head")
CHROME, TABLES, MAJOR, OPENING, MERGED = ("visually-hidden", "accordion-title", "subtitle"), ("role-taxtable",), "role-major-section", ("role-hd1", "role-step-section"), ("role-hd2", "role-hd3")
OPEN, DROP, MERGE = "open", "drop", "merge"
ROLES = "array<struct<sequence:int,level:int,anchor:string,heading:string,above:string,texts:array<string>>>"


def role(tag: str, classes: str) -> tuple[str | None, int]:
    """What a heading does, and the level of the section that it opens: OPEN a section, DROP all up to the next one of the first level, MERGE into the section above, or nothing."""
    has = lambda names: any(n in classes for n in names)
    if tag == "h2":
        if has(CHROME):
            return None, 0
        return (DROP, 0) if has(TABLES) else (OPEN, 1) if not classes or MAJOR in classes else (None, 0)
    if tag == "h3":
        return OPEN, 2
    return (OPEN, 3) if has(OPENING) else (MERGE, 0) if has(MERGED) else (None, 0)


@dataclass
class _Section:
    level: int
    anchor: str | None
    heading: str = ""
    texts: list[str] = field(default_factory=list)
    above: str = ""


class _Walker(HTMLParser):
    """Reads a page tag by tag. There is one open section, and one stretch of words at a time: a heading's or a paragraph's."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[_Section] = []
        self.open: _Section | None = None
        self.heading: str | None = None  # the tag of the heading that is being read
        self.paragraph = self.dropping = self.detailed = False
        self.hidden, self.major, self.words = 0, "", []

    def end_section(self) -> None:
        if self.open and self.open.heading:
            self.open.above = self.major
            self.done.append(self.open)
        self.open = None

    def said(self) -> str:
        words, self.words = self.words, []
        return " ".join(words).strip()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in HIDDEN
        if self.hidden:
            return
        own = dict(attrs)
        if tag in ("h2", "h3", "h4"):
            self._begin(tag, own)
        elif tag == "a" and own.get("name") and self.heading and self.open and not self.open.anchor:
            self.open.anchor = own["name"]
        elif tag == "p" and not self.dropping:
            self.paragraph, self.words = True, []

    def _begin(self, tag: str, own: dict) -> None:
        does, level = role(tag, own.get("class") or "")
        if does == DROP:
            self.end_section()
            self.dropping = True
        elif does == OPEN and (level == 1 or not self.dropping):
            self.end_section()
            self.dropping, self.detailed = False, level == 3
            self.open, self.heading, self.words = _Section(level, own.get("id")), tag, []
        elif does == MERGE and self.detailed and not self.dropping:
            self.heading, self.words = None, []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == self.heading:
            text, self.heading = self.said(), None
            if self.open:
                self.open.heading = text
            if tag == "h2":
                self.major = text
        elif tag == "p" and self.paragraph:
            text, self.paragraph = self.said(), False
            if text and self.open:
                self.open.texts.append(text)

    def handle_data(self, data: str) -> None:
        flat = data.replace("\n", " ").replace("\r", "")
        if not self.hidden and (self.heading or self.paragraph) and flat.strip():
            self.words.append(flat)


def _by_role(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("sequence", pa.int32()), ("level", pa.int32()), ("anchor", pa.string()), ("heading", pa.string()), ("above", pa.string()), ("texts", pa.list_(pa.string()))]))
    for array in batches:
        out = []
        for page in array.to_pylist():
            walker = _Walker()
            walker.feed(page or "")
            walker.close()
            walker.end_section()
            out.append([{"sequence": i, "level": s.level, "anchor": s.anchor, "heading": s.heading, "above": s.above, "texts": s.texts} for i, s in enumerate(walker.done)])
        yield pa.array(out, kind)


def sections_by_role(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, sequence, level, anchor, heading, above, texts) of pages whose headings have roles in their classes: h2 of a major section or without a class, h3, and h4 of lines open sections of levels 1 to 3;
    h4 below those merge into them; navigation and blocks of tables have no part; of the rest only paragraphs are kept. above: the heading of level 1 over a section. A paragraph that isn't closed before the next begins is lost; a section without a heading, and a null page, give none."""
    made = F.arrow_udf(_by_role, ROLES).asNondeterministic()(F.col(html_col))
    return pages.select(id_col, F.explode(made).alias("s")).select(id_col, "s.*")
