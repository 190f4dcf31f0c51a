"""Packing of paragraphs into chunks bounded in tokens, each with the pages that it begins and ends on.

A Packer takes the paragraphs of one heading in their order and holds one chunk at a time. Sizes are those of the joined text by a counter of tokens, by default a quarter of its characters:

* A paragraph joins the chunk while the chunk stays within target; else the chunk ends, and the next begins with the last sentences of it that have at most overlap tokens, fewer
  of them where the new paragraph leaves less room below hard.
* A paragraph over hard ends the chunk and is packed in chunks of its own, sentence by sentence in the same way; a sentence over hard is cut between words, a word over hard between characters.

So no chunk has more than hard tokens, with any counter that doesn't count more in a part of a text than in all of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET, OVERLAP, HARD = 400, 50, 512
Counter = Callable[[str], int]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def quarter(text: str) -> int:
    """The estimate of questions.tokens."""
    return max(1, len(text) // 4)


class Packer:
    """add() paragraphs with their pages, flush() at each heading; both give the chunks that are ready: (text, tokens, first page, last page)."""

    def __init__(self, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD, count: Counter = quarter) -> None:
        self.target, self.overlap, self.hard, self.count = target, overlap, hard, count
        self.parts: list[tuple[str, object]] = []

    def _size(self, parts: list[tuple[str, object]]) -> int:
        return self.count(" ".join(t for t, _ in parts)) if parts else 0

    def flush(self) -> list[tuple]:
        parts, self.parts = self.parts, []
        text = " ".join(t for t, _ in parts)
        return [(text, self.count(text), parts[0][1], parts[-1][1])] if parts else []

    def _tail(self) -> list[tuple[str, object]]:
        """The last sentences of the chunk that have at most overlap tokens together."""
        tail: list[tuple[str, object]] = []
        for text, page in reversed(self.parts):
            for sentence in reversed(_SENTENCE.split(text)):
                if self._size([(sentence, page), *tail]) > self.overlap:
                    return tail
                tail.insert(0, (sentence, page))
        return tail

    def _unit(self, text: str, page: object) -> list[tuple]:
        """One more paragraph or sentence of at most hard tokens."""
        out: list[tuple] = []
        if self.parts and self._size([*self.parts, (text, page)]) > self.target:
            tail = self._tail()
            out = self.flush()
            while tail and self._size([*tail, (text, page)]) > self.hard:
                tail.pop(0)
            self.parts = tail
        self.parts.append((text, page))
        return out

    def _cut(self, text: str, join: str = " ") -> Iterator[str]:
        """A text over hard in pieces of at most hard: as many words, or characters of one word, as fit."""
        items = text.split() if join else list(text)
        begin = 0
        while begin < len(items):
            low, high = begin + 1, len(items)  # the most items that fit; one at least
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self.count(join.join(items[begin:middle])) <= self.hard else (low, middle - 1)
            piece = join.join(items[begin:low])
            if join and self.count(piece) > self.hard:
                yield from self._cut(piece, "")
            else:
                yield piece
            begin = low

    def add(self, text: str, page: object = None) -> list[tuple]:
        if self.count(text) <= self.hard:
            return self._unit(text, page)
        out = self.flush()
        for sentence in _SENTENCE.split(text):
            for piece in [sentence] if self.count(sentence) <= self.hard else self._cut(sentence):
                out += self._unit(piece, page)
        return out + self.flush()


def _bounded() -> None:
    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def chunks(text: Column | str, delimiter: str = "\n\n", target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD, count: Counter = quarter) -> Column:
    """array<struct<text, tokens>> of the chunks of a text whose paragraphs the delimiter parts. In Arrow batches of at most 8 MB unless the session sets its own bound. A null text has none."""
    _bounded()

    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            rows = []
            for value in array.to_pylist():
                packer = Packer(target, overlap, hard, count)
                found = [c for p in (value or "").split(delimiter) if p.strip() for c in packer.add(p.strip())] + packer.flush()
                rows.append([{"text": t, "tokens": n} for t, n, _, _ in found])
            yield pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32())])))

    return F.arrow_udf(each, "array<struct<text:string,tokens:int>>").asNondeterministic()(text)


WALKED = ("chunk_index", "chapter", "section", "page_start", "page_end", "text", "token_count")


def walked(lines: DataFrame, doc: str, least: int = 10, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD, count: Counter = quarter) -> DataFrame:
    """lines (doc, page, at, line, chapter and section that the line itself names) to (doc, chunk_index, chapter, section, page_start, page_end, text, token_count).

    One shuffle by document; each task then walks its documents line by line in order and holds no more than a paragraph and a chunk, however long a document is. A line that names a chapter or
    section ends the chunk; a new chapter ends the section. Blank lines and page ends part paragraphs; those of least characters or fewer are dropped. A document without paragraphs has no chunks."""
    _bounded()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(target, overlap, hard, count)
        none = object()
        own, index, chapter, section, page, paragraph = none, 0, None, None, None, []
        out: list[tuple] = []

        def emit(found: list[tuple]) -> None:
            nonlocal index
            for text, tokens, first, last in found:
                out.append((own, index, chapter, section, first, last, text, tokens))
                index += 1

        def close() -> None:
            text = " ".join(paragraph).strip()
            paragraph.clear()
            if len(text) > least:
                emit(packer.add(text, page))

        kind = None
        for batch in batches:
            kind = batch.schema.field(doc).type
            for d, p, line, new_chapter, new_section in zip(*(batch[c].to_pylist() for c in (doc, "page", "line", "chapter", "section")), strict=True):
                if d != own or own is none:
                    if own is not none:
                        close()
                        emit(packer.flush())
                    own, index, chapter, section, page = d, 0, None, None, p
                if p != page:
                    close()
                    page = p
                if new_chapter is not None or new_section is not None:
                    close()
                    emit(packer.flush())
                    chapter, section = (new_chapter, None) if new_chapter is not None else (chapter, new_section)
                elif line.strip():
                    paragraph.append(line.strip())
                else:
                    close()
            yield _batch(out, doc, kind)
            out.clear()
        if own is not none:
            close()
            emit(packer.flush())
            yield _batch(out, doc, kind)

    rows = lines.filter(F.col(doc).isNotNull()).select(doc, F.col("page").cast("bigint").alias("page"), "at", "line", "chapter", "section").repartition(doc).sortWithinPartitions(doc, "page", "at")
    return rows.mapInArrow(each, f"`{doc}` {lines.schema[doc].dataType.simpleString()}, chunk_index int, chapter string, section string, page_start bigint, page_end bigint, text string, token_count int")


def _batch(rows: list[tuple], doc: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [doc, *WALKED])
