"""Counts over whole texts, and the ratios made of them that the quality operators learn from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import arrow_column

SPACE, SYMBOLS, UPPER, DIGITS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_bangs", "n_stops", "longest_word", "longest_line")
SCHEMA = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text; the first occurrence counts too."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def counts(text: bytes, chars: int) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text of so many code points."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), chars - less(SPACE), less(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), len(set(words)), less(UPPER), less(DIGITS),
        text.count(b"!"), text.count(b"."), max(map(len, words), default=0), max(map(len, lines), default=0),
    )


def _batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in texts:
        array = pc.fill_null(array, "")
        rows = [counts(t.as_py(), n) for t, n in zip(array.cast(pa.binary()), pc.utf8_length(array).to_pylist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def text_counts(text: Column | str) -> Column:
    """A struct of COUNTS for each text; null is the empty text."""
    return arrow_column(_batches, SCHEMA, text)


def features(c: str) -> dict[str, Column]:
    """Ratios of the counts in struct column c: each is between bounds that don't grow with the text, and none is null."""
    n = lambda x: F.col(f"{c}.{x}").cast("double")
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "words_log": F.log1p(n("n_words")),
        "word_length": per(n("word_chars"), n("n_words")),
        "symbols": per(n("n_symbols"), n("word_chars")),
        "dup_lines": per(n("n_dup_lines"), n("n_lines")),
        "repeats": per(n("n_repeat_words"), n("n_words")),
        "distinct": per(n("n_distinct"), n("n_words")),
        "upper": per(n("n_upper"), n("word_chars")),
        "digits": per(n("n_digits"), n("word_chars")),
        "bangs": per(n("n_bangs"), n("n_words")),
        "stops": per(n("n_stops"), n("n_words")),
        "line_words": per(n("n_words"), n("n_lines")),
        "longest_word_log": F.log1p(n("longest_word")),
        "longest_line": per(n("longest_line"), n("word_chars")),
    }
