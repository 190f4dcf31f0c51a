"""Periodic runs of words: stretches in which the words q apart are identical, found by the runs theorem.

The words of many texts stand in one array, each text closed by an end mark of its own that sorts before all words. Its suffix array comes from prefix doubling. The longest Lyndon
word at a place ends before the next smaller value of the inverse suffix array, and under the reversed order of words before the next greater
one; by the runs theorem the Lyndon roots of all runs are among those. A root is carried on to the right by the longest common prefix of its
place and the place one period later (LCP array and a sparse table of range minima), and to the left by the same over the reversed words of the texts
that still have candidates.

Numpy inside Arrow batches: a task holds the words of about PORTION bytes of text, or of one longer text. A lost task is run again; nothing is shuffled.

Nulls: a null text has no words, no runs and the collapsed text ''. Repeated rows are judged one by one; other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from .common import arrow_column

PORTION = 1 << 20
SCHEMA = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def suffix_ranks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of s and its inverse. s ends with a value that stands nowhere else."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    heads = np.concatenate(([True], s[order[1:]] != s[order[:-1]]))
    first = np.flatnonzero(heads)
    place = np.repeat(first, np.diff(np.append(first, n)))  # of each suffix in order: where its group begins
    rank = np.empty(n, np.int64)
    rank[order] = place
    sa, k = order, 1
    alone = heads & np.append(heads[1:], True)
    spot = np.flatnonzero(~alone)  # places of the suffix array that are still open
    while len(spot):
        open_, head = sa[spot], place[spot]
        key = head * n + rank[open_ + k]
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        sa[spot] = open_
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(spot)))
        place[spot] = np.repeat(spot[begin], size)
        rank[open_] = place[spot]
        spot = spot[np.repeat(size > 1, size)]
        k *= 2
    return sa, rank


def common_prefixes(s: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: how many values the suffixes of ranks r - 1 and r have in common at their beginnings."""
    n, text, ranks, before = len(s), s.tolist(), rank.tolist(), np.concatenate(([-1], sa[:-1])).tolist()
    out, h = [0] * n, 0
    for i in range(n):
        j = before[ranks[i]]
        if j < 0:
            h = 0
            continue
        while text[i + h] == text[j + h]:  # the end marks differ, so neither goes over the end
            h += 1
        out[ranks[i]] = h
        if h:
            h -= 1
    return np.array(out, np.int32)


class Extensions:
    """Longest common prefixes of any two suffixes, from range minima of the LCP array."""

    def __init__(self, s: np.ndarray) -> None:
        self.sa, self.rank = suffix_ranks(s)
        self.table = [common_prefixes(s, self.sa, self.rank)]
        while 2 << (len(self.table) - 1) <= len(s):
            last, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-w], last[w:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i != j elementwise."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] + 1 - (1 << int(k))])
        return out


def next_outside(rank: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the next one of smaller rank and the next one of greater rank, at most the end mark of its text."""
    low, n = rank.tolist(), len(rank)
    stop = rank.copy()
    stop[ends] = n
    high, less, more = stop.tolist(), list(range(1, n + 1)), list(range(1, n + 1))
    less[n - 1] = more[n - 1] = n - 1
    closed = np.zeros(n, bool)
    closed[ends] = True
    for i, end in zip(range(n - 1, -1, -1), closed[::-1].tolist(), strict=True):
        if end:
            continue
        v, j = low[i], i + 1
        while low[j] > v:
            j = less[j]
        less[i] = j
        j = i + 1
        while high[j] < v:
            j = more[j]
        more[i] = j
    return np.array(less), np.array(more)


def _marked(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an end mark after each text, all marks different and below all words; and where the marks stand."""
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    s = np.empty(len(codes) + n, np.int64)
    words = np.ones(len(s), bool)
    words[ends] = False
    s[words], s[ends] = codes + n, np.arange(n)
    return s, ends


def find_runs(codes: np.ndarray, at: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of length >= max(min_length, min_exponent * period): text, start in it, length, period; by text, start and period. codes: words as numbers, those of text i from at[i] to at[i + 1]; min_exponent: 2 or more."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none, none
    s, ends = _marked(codes, at)
    begins = ends - np.diff(at)
    right = Extensions(s)
    roots = []
    for ahead in next_outside(right.rank, ends):
        i = np.flatnonzero(s[ahead] == s)  # the root comes once more, at least its first word does
        i = i[ahead[i] > i]
        roots.append(np.stack((i, ahead[i] - i)))
    i, q = np.unique(np.concatenate(roots, 1), axis=1) if sum(r.shape[1] for r in roots) else (none, none)
    r = right.of(i, i + q) if len(i) else none
    # A run has a root in its first q words, so fewer than q words stand before one of its roots.
    enough = (r > (min_exponent - 2) * q) & (r + 2 * q > min_length)
    i, q, r = i[enough], q[enough], r[enough]
    if not len(i):
        return none, none, none, none
    text = np.searchsorted(ends, i)
    some, own = np.unique(text, return_inverse=True)
    # The texts that have candidates once more, backwards.
    size = np.diff(at)[some]
    back_at = np.concatenate(([0], np.cumsum(size)))
    mirror = np.repeat(at[:-1][some] + size - 1, size) - (np.arange(back_at[-1]) - np.repeat(back_at[:-1], size))
    b, b_ends = _marked(codes[mirror], back_at)
    left = Extensions(b)
    mirrored = b_ends[own] - 1 - (i - begins[text])  # where word i stands backwards; the one before it is the next
    back = left.of(mirrored + 1, mirrored + 1 - q)
    start, length = i - back - begins[text], back + q + r
    whole = length >= np.maximum(min_length, min_exponent * q)
    rows = np.unique(np.stack((text[whole], start[whole], q[whole], length[whole])), axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of an array of texts, each with a space after it, as a dictionary array; and where those of each text begin and the last end."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.zeros(0, np.uint8)
    cut = places[1:-1] - places[0] if len(texts) else places
    data = np.concatenate((np.insert(data, cut, 32), [np.uint8(32)])).astype(np.uint8)  # one space between texts
    text_end = places[1:] - places[0] + np.arange(len(texts))
    white = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))  # the white character after each word
    keep = ~white
    keep[last] = True
    data = np.where(white, np.uint8(32), data)
    offsets = np.concatenate(([0], np.cumsum(keep)[last])).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(last), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    return words.dictionary_encode(), np.concatenate(([0], np.searchsorted(last, text_end, side="right")))


def joined(words: pa.DictionaryArray, codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of the words codes, joined by one space."""
    flat = words.dictionary.take(pa.array(codes))
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)[at] if len(flat) else np.zeros(len(at), np.int64)
    with_space = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), flat.buffers()[2] if len(flat) else pa.py_buffer(b"")])
    return pc.binary_slice(with_space.cast(pa.binary()), 0, -1).cast(pa.string())


def _portion(texts: pa.Array, min_length: int, min_exponent: int) -> pa.StructArray:
    words, at = split_words(texts)
    codes = words.indices.to_numpy().astype(np.int64)
    text, start, length, period = find_runs(codes, at, min_length, min_exponent)
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, at[text] + start + period, 1)
    np.add.at(steps, at[text] + start + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    kept_at = np.concatenate(([0], np.cumsum(kept)))[at]
    each = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), each)
    return pa.StructArray.from_arrays([runs, joined(words, codes[kept], kept_at)], ["runs", "collapsed"])


def periodic_runs(text: Column | str, min_length: int = 6, min_exponent: int = 4) -> Column:
    """A struct for each text: runs (start and length in words, period), by start, then period, of length >= max(min_length, min_exponent * period) and min_exponent >= 2; and
    collapsed, the words joined by one space without those that stand in a run after its first period."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            size = np.cumsum(pc.binary_length(array).fill_null(0).to_numpy())
            begin, parts = 0, []
            while begin < len(array):
                end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PORTION, "right")))
                parts.append(_portion(array.slice(begin, end - begin), min_length, min_exponent))
                begin = end
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())]))

    return arrow_column(each, SCHEMA, text)
