"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes of a text.

A whole Arrow portion is aligned at once: the byte lengths of all A tokens, one text after the other, give by a running sum the offsets at which they end, those of B the same, and a text's own offset
is where its tokens begin. Both sets of ends are counted once over the offsets of the portion; where both have one, a group of tokens is cut. Running sums over
the cuts number the groups, and differences of the sums at the bounds of a text recover its own figures.

A link is an occurrence of an A token and one of a B token in one group. The corpus-wide count of an id pair is the number of documents that hold it linked. Each portion is written as one row with its different pairs,
the number of its documents that hold each, and which pairs each document holds how often. Pairs, summed over a portion already, are summed over all
portions by a shuffle on both ids, so a frequent pair costs a row a portion, not one a document; the counts go back to the portions by a join and a
sort by portion, and each portion weighs its own documents. A task holds one portion with its counts at a time, and the table of portions has row groups of few portions, however many there are. Groups whose tokens make many links are written down by id and number of occurrences, and portions of more than LINKS links in several rows, each for a range
of A ids, so memory is bounded by the portion (about PORTION bytes of text, or one longer text).

Nulls: a null or empty text, or one whose joined tokens differ from the text with a space before it (B's normalizing, a U+2581 in the text), has no tokens: its figures are 0 and its lists empty. Ids may be null or repeat: documents are told apart by their place.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .tokenizing import default_tokenizer, encoder

PORTION, LINKS, WIDE = 1 << 20, 4_000_000, 64
#: Bytes of a row group of the table of portions; a row has some hundred thousand values of which many take a bit or less.
ROW_GROUP = 4 << 20
#: Bits of a token id in keys of (text, A id, B id); 15 bits are left for the texts of a portion.
BITS = 24
MASK = (1 << BITS) - 1
#: Bytes of the printable ASCII and Latin-1 characters by which a byte-level BPE writes bytes as they are; all others are written as U+0100 and following.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in _PLAIN]
    return {**{chr(b): b for b in _PLAIN}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """The bytes of each id: all of them in one array and where each id's begin."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        till = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - till + n, n) + np.arange(till[-1] if len(till) else 0)]


@cache
def _a(path: str) -> tuple:
    coder, alphabet = encoder(path, True), byte_alphabet()
    entries = [b""] * len(coder.opens)
    for token, i in coder.library.get_vocab(with_added_tokens=True).items():
        entries[i] = bytes(alphabet[c] for c in token)
    return coder, Vocabulary(entries)


@cache
def _b(path: str) -> tuple:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return model, Vocabulary(entries)


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Portion:
    """Texts aligned together: ids of both sides one text after the other, where each text's begin (and the last end), the group of each token, and where each text's groups begin."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray

    def in_group(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of A and of B tokens of each group."""
        n = int(self.group_at[-1])
        return np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)


def _only(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    return ids[np.repeat(keep, size)], np.concatenate(([0], np.cumsum(np.where(keep, size, 0))))


def align(texts: pa.Array, a_path: str, b_path: str) -> Portion:
    """The tokens of an array of texts in groups."""
    (a_coder, a_words), (b_coder, b_words) = _a(a_path), _b(b_path)
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    spaced = pc.if_else(pa.array(empty), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    a, a_at = a_coder.encode(spaced, spaced=True)
    a = a.astype(np.int64)
    found = b_coder.encode(texts.to_pylist(), num_threads=1)
    b_at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
    b = np.fromiter(chain.from_iterable(found), np.int64, int(b_at[-1]))
    del found
    spaced = pa.concat_arrays([spaced.cast(pa.large_binary())])
    at = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, 8 * spaced.offset) if len(spaced) else np.zeros(1, np.int64)
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    same = ~empty
    for ids, own, words in ((a, a_at, a_words), (b, b_at, b_words)):
        place = np.concatenate(([0], np.cumsum(words.size[ids])))[own]
        same &= np.diff(place) == np.diff(at)
        flat, fits = words.joined(ids), same & (np.diff(at) > 0)
        wrong = flat[np.repeat(fits, np.diff(place))] != data[np.repeat(fits, np.diff(at))]
        ends = np.concatenate(([0], np.cumsum(np.where(fits, np.diff(at), 0))))
        same &= np.diff(np.concatenate(([0], np.cumsum(wrong)))[ends]) == 0
    (a, a_at), (b, b_at) = _only(a, a_at, same), _only(b, b_at, same)
    length = int(np.where(same, np.diff(at), 0).sum())
    a_end, b_end = np.cumsum(a_words.size[a]), np.cumsum(b_words.size[b])
    cut = (np.bincount(a_end, minlength=length + 1) > 0) & (np.bincount(b_end, minlength=length + 1) > 0)
    cut[0] = False
    number = np.cumsum(cut)  # groups that end at an offset or before it
    own = np.concatenate(([0], np.cumsum(np.where(same, np.diff(at), 0))))
    return Portion(a, a_at, b, b_at, number[a_end - 1], number[b_end - 1], number[own])


def _text_pairs(p: Portion, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, A id, B id and number of links of each different pair of a text; by text, then ids. A ids from low up to high."""
    n_a, n_b = p.in_group()
    text_of = np.repeat(np.arange(len(p.a_at) - 1), np.diff(p.group_at))
    here = (p.a >= low) & (p.a < high)
    a, a_group = p.a[here], p.a_group[here]
    wide = (n_a * n_b > WIDE)[a_group] if len(a_group) else np.zeros(0, bool)
    b_begin = np.concatenate(([0], np.cumsum(n_b)))

    def product(ids: np.ndarray, group: np.ndarray, times: np.ndarray, b_ids: np.ndarray, begin: np.ndarray, size: np.ndarray, b_times: np.ndarray | None) -> tuple[np.ndarray, ...]:
        n = size[group]
        left = np.repeat(np.arange(len(ids)), n)
        right = np.repeat(begin[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
        weight = times[left] if b_times is None else times[left] * b_times[right]
        return (text_of[group] << 2 * BITS | ids << BITS)[left] | b_ids[right], weight

    keys, weights = product(a[~wide], a_group[~wide], np.ones(int((~wide).sum()), np.int64), p.b, b_begin[:-1], n_b, None)
    if wide.any():
        # Groups of many tokens: each id once with its number of occurrences.
        own, times = np.unique(a_group[wide] << BITS | a[wide], return_counts=True)
        b_wide = (n_a * n_b > WIDE)[p.b_group]
        other, b_times = np.unique(p.b_group[b_wide] << BITS | p.b[b_wide], return_counts=True)
        size = np.bincount(other >> BITS, minlength=len(n_a))
        more, heavy = product(own & MASK, own >> BITS, times, other & MASK, np.cumsum(size) - size, size, b_times)
        keys, weights = np.concatenate((keys, more)), np.concatenate((weights, heavy))
    if not len(keys):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys = keys[first]
    return keys >> 2 * BITS, keys >> BITS & MASK, keys & MASK, np.add.reduceat(weights, first)


def _ranges(p: Portion) -> list[tuple[int, int]]:
    """Ranges of A ids of at most about LINKS links together."""
    _, n_b = p.in_group()
    by_id = np.bincount(p.a, n_b[p.a_group] if len(p.a) else None, minlength=1)
    number = (np.cumsum(by_id) // LINKS).astype(int)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(by_id)]))
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def _slices(array: pa.Array) -> Iterator[tuple[int, int]]:
    """Parts of the array of about PORTION bytes of text."""
    size = np.cumsum(pc.binary_length(array).fill_null(0).to_numpy())
    begin = 0
    while begin < len(array):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PORTION, "right")))
        yield begin, min(end, begin + (1 << 15))
        begin = min(end, begin + (1 << 15))


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
#: A portion's number has 20 bits for its place in its task. Its rows add RANGE bits for the range of A ids, its documents PLACE bits.
IN_TASK, RANGE, PLACE = 20, 16, 15
STORED = "portion bigint, doc_id array<bigint>, figures array<array<bigint>>, extra array<string>, a array<int>, b array<int>, documents array<int>, at array<int>, pair array<int>, times array<bigint>"


def _stored(a_path: str, b_path: str, extra: Callable[[Portion], list[str]] | None):
    kind = pa.schema([("portion", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("figures", pa.list_(pa.list_(pa.int64()))), ("extra", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("a", "b", "documents", "at", "pair")), ("times", pa.list_(pa.int64()))])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin, end in _slices(batch["text"]):
                ids = batch["doc_id"].slice(begin, end - begin)
                p = align(batch["text"].slice(begin, end - begin), a_path, b_path)
                n_a, n_b = p.in_group()
                links = np.concatenate(([0], np.cumsum(n_a * n_b)))[p.group_at]
                figures = [np.diff(p.a_at), np.diff(p.b_at), np.diff(p.group_at), np.diff(links)]
                for k, (low, high) in enumerate(_ranges(p)):
                    text, a, b, times = _text_pairs(p, low, high)
                    pairs, pair, documents = np.unique(a << BITS | b, return_inverse=True, return_counts=True)
                    at = np.searchsorted(text, np.arange(end - begin + 1))
                    base = [f.tolist() for f in figures] if k == 0 else [[0] * (end - begin)] * len(figures)
                    said = extra(p) if extra and k == 0 else [None] * (end - begin)
                    lists = (ids, base, said, pairs >> BITS, pairs & MASK, documents, at, pair, times)
                    yield pa.RecordBatch.from_arrays([pa.array([(task << IN_TASK | number) << RANGE | k]), *(_list(v, f.type) for v, f in zip(lists, list(kind)[1:], strict=True))], schema=kind)
                number += 1

    return each


def _list(values, kind: pa.DataType) -> pa.Array:
    """One list of values."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type))


def _weighed(portion: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one row of the portions, with the counts of its pairs."""
    row = portion.combine_chunks()
    get = lambda c: row[c].chunk(0)[0].values
    at, pair, times = (get(c).to_numpy() for c in ("at", "pair", "times"))
    count, best = np.zeros((2, found.num_rows), np.int64)
    pos = found["pos"].to_numpy()
    count[pos], best[pos] = found["count"].to_numpy(), found["best"].to_numpy()
    sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[pair])))[at]) for x in (best, count)]
    place = (row["portion"][0].as_py() >> RANGE << PLACE) + np.arange(len(at) - 1)
    figures = [get("figures")[k].values for k in range(len(FIGURES))]
    return pa.table([pa.array(place), get("doc_id"), *figures, *map(pa.array, sums), get("extra")], ["place", "doc_id", *FIGURES, "n_best", "count_sum", "extra"])


def linked(docs: DataFrame, models: tuple[str, str] | None = None, extra: Callable[[Portion], list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of its A id, ties included), count_sum (the counts of its links), and extra, what a
    function of a Portion says of each of its texts (without one null)."""
    a_path, b_path = models or default_models()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    portions = written(map_batches(rows, _stored(a_path, b_path, extra), STORED), "aligned", "zstd", ROW_GROUP)
    pairs = portions.select("portion", F.posexplode(F.arrays_zip("a", "b", "documents")).alias("pos", "p")).select("portion", "pos", "p.a", "p.b", "p.documents")
    counts = pairs.groupBy("a", "b").agg(F.sum("documents").alias("count"))
    counts = written(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))), "pair-counts")
    found = pairs.join(counts, ["a", "b"]).select(F.col("portion").alias("own"), "pos", "count", "best")
    kind = "place bigint, doc_id bigint, " + ", ".join(f"{c} bigint" for c in (*FIGURES, "n_best", "count_sum")) + ", extra string"
    parts = portions.drop("a", "b", "documents").groupBy("portion").cogroup(found.groupBy("own")).applyInArrow(_weighed, kind)
    return parts.groupBy("place").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in (*FIGURES, "n_best", "count_sum")), F.max("extra").alias("extra")).drop("place")


def _lists(a_path: str, b_path: str):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(batch["text"]):
                p = align(batch["text"].slice(begin, end - begin), a_path, b_path)
                n_a, n_b = p.in_group()
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v, at in ((p.a, p.a_at), (p.b, p.b_at), (n_a, p.group_at), (n_b, p.group_at))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, end - begin), *columns], ["doc_id", "a", "b", "a_in_group", "b_in_group"])

    return each


def aligned(docs: DataFrame, models: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, the ids of both sides, and how many of each stand in its first, second, ... group."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, _lists(*(models or default_models())), "doc_id bigint, a array<int>, b array<int>, a_in_group array<int>, b_in_group array<int>")
