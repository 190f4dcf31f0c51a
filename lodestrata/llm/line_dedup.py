"""Line dedup: repeated runs of whole lines are found by winnowing over line hashes and deleted after their first place.

A run is a sequence of consecutive lines that have a word (lines without one don't count and don't part a run). What is deleted: every line that
lies in a run of RUN words or more of which an identical run stands earlier, that is, in a document before it or, without overlap, higher up in
the same document. Documents are ordered by id (null ids last), then by the hash of the text; rows equal in both are the same document and lose
the same lines.

1. Winnowing. A window opens at each line and closes where it has RUN words; of each window the line with the least hash is selected (of equals,
   the last). A repeated run of RUN words holds the window that opens at its first line, so both places select the same line: guaranteed.
2. Positions. Selected lines are counted by hash; those selected twice or more are seeds, joined back to their positions. A count is all that
   is kept of a hash, so a line that a third of the corpus shares makes one row, no pairs.
3. Extension. From each seed, matches are extended to both sides by the windows around it that hold the seed: those that close RUN words after
   a line and those that open RUN words before one. Each line of a repeated run is in such a window inside the run, so joining windows to the
   first place of the same lines yields the whole run, and no more.
4. Deletion. Windows that have an earlier place become ranges of lines, gathered for each document, and the text is put together without them.

Nulls: a null text stays null. Empty texts and texts under RUN words stay as they are. A text may become empty; its row stays. Ids are whole numbers; an id that isn't one is an error. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, drop_written, fresh, map_batches, written

RUN = 50
LAST = (1 << 63) - 1
LINES = "a bigint, b bigint, hashes binary, words array<int>, picks array<int>"
WINDOWS = "hi bigint, lo bigint, a bigint, b bigint, s int, e int"


def windows(words: np.ndarray, run: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest window of at least run words that opens (or, back, closes) at each line, where there is one."""
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    if back:
        e = np.arange(len(words))
        s = np.searchsorted(total, total[1:] - run, side="right") - 1
        return s[s >= 0], e[s >= 0]
    s = np.arange(len(words))
    e = np.searchsorted(total, total[:-1] + run, side="left") - 1
    return s[e < len(words)], e[e < len(words)]


def picks(hashes: np.ndarray, words: np.ndarray, run: int) -> np.ndarray:
    """Lines that winnowing selects: of each window the least hash, the last of equals. Windows open and close in order, so a deque of candidates serves all."""
    out, queue, head, at = [], [], 0, 0
    for s, e in zip(*windows(words, run), strict=True):
        while at <= e:
            while len(queue) > head and hashes[queue[-1]] >= hashes[at]:
                queue.pop()
            queue.append(at)
            at += 1
        while queue[head] < s:
            head += 1
        out.append(queue[head])
    return np.unique(np.array(out, np.int32))


def _lines(run: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                lines = [x for x in text.as_py().split(b"\n") if x.strip()]
                words = np.array([len(x.split()) for x in lines], np.int32)
                if words.sum() < run:
                    continue
                hashes = b"".join(map(xxhash.xxh3_128_digest, lines))
                chosen = picks([hashes[i : i + 16] for i in range(0, len(hashes), 16)], words, run)
                rows.append((a, b, hashes, words, chosen))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "hashes", "words", "picks"])

    return each


def _around(run: int):
    """For each document with seeds: the windows that hold one, by the 128-bit hash of their lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for a, b, hashes, words, seeds in zip(*(batch[c].to_pylist() for c in ("a", "b", "hashes", "words", "seeds")), strict=True):
                words = np.array(words, np.int32)
                held = np.concatenate(([0], np.cumsum(np.isin(np.arange(len(words)), seeds))))
                spans = set()
                for back in (False, True):
                    s, e = windows(words, run, back)
                    with_seed = held[e + 1] > held[s]
                    spans.update(zip(s[with_seed].tolist(), e[with_seed].tolist(), strict=True))
                for s, e in sorted(spans):
                    key = xxhash.xxh3_128_digest(hashes[16 * s : 16 * e + 16])
                    for column, value in zip(out, (int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), a, b, s, e), strict=True):
                        column.append(value)
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["hi", "lo", "a", "b", "s", "e"])

    return each


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(a, b, ranges): for each document that loses lines, by order key, the ranges (first, last) of lines with a word that go."""
    keyed = docs.select(_order(id_col).alias("a"), F.xxhash64(text_col).alias("b"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    lines = written(map_batches(keyed, _lines(run), LINES), "lines")
    chosen = lines.select("a", "b", F.explode("picks").alias("at"), "hashes").select("a", "b", "at", F.expr("substring(hashes, 16 * at + 1, 16)").alias("hash"))
    shared = written(chosen.groupBy("hash").count().filter("count > 1").select("hash"), "shared")
    seeds = chosen.join(shared, "hash").groupBy("a", "b").agg(F.collect_set("at").alias("seeds"))
    found = written(map_batches(lines.dropDuplicates(["a", "b"]).select("a", "b", "hashes", "words").join(seeds, ["a", "b"]), _around(run), WINDOWS), "windows")
    first = written(found.groupBy("hi", "lo").agg(F.min(F.struct("a", "b", "s", "e")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hi", "lo", "first"), "first")
    same = (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    later = found.join(first, ["hi", "lo"]).filter(~same | (F.col("s") > F.col("first.e")))
    ranges = written(later.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("ranges")), "ranges")
    for table in (lines, shared, found, first):
        drop_written(table)
    return ranges


def _order(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))


def _without(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, ranges in texts:
        out = []
        for t, spans in zip(text.cast(pa.binary()).to_pylist(), ranges.to_pylist(), strict=True):
            if not spans:
                out.append((t, 0, 0))
                continue
            kept, at, gone, words, i, inside = [], -1, 0, 0, 0, -1
            spans = merged([(x["s"], x["e"]) for x in spans])
            for line in t.split(b"\n"):
                n = len(line.split())
                at += n > 0
                while n and i < len(spans) and spans[i][1] < at:
                    i += 1
                if n:
                    inside = i < len(spans) and spans[i][0] <= at
                    gone, words = (gone + 1, words + n) if inside else (gone, words)
                    if not inside:
                        kept.append(line)
                elif not (inside is True and i < len(spans) and at < spans[i][1]):
                    kept.append(line)
            out.append((b"\n".join(kept), gone, words))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.StructArray.from_arrays([pc.cast(pa.array(columns[0], pa.binary()), pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["text", "lines", "words"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges as disjoint ranges; ranges that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, out: str = "deleted") -> DataFrame:
    """docs with the repeated runs gone from the text, and one more column: a struct of the lines and words that went."""
    a, b, r, new = fresh(docs, "a", "b", "ranges", "new")
    ranges = repeats(docs, id_col, text_col, run).select(F.col("a").alias(a), F.col("b").alias(b), F.col("ranges").alias(r))
    keyed = docs.withColumns({a: _order(id_col), b: F.xxhash64(text_col)})
    joined = keyed.join(ranges.hint("shuffle_hash"), [a, b], "left")
    done = joined.withColumn(new, arrow_column(_without, "struct<text:string,lines:bigint,words:bigint>", F.col(text_col), F.col(r)))
    return done.select(*(F.col(f"{new}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns), F.struct(f"{new}.lines", f"{new}.words").alias(out))
