"""Media columns: chroma fingerprints of audio, and an index that aligns recordings by them.

A recording (a binary column of PCM16 WAV, any rate and number of channels) is mixed to one channel and resampled to RATE. Frames of FRAME samples,
HOP apart, give the energy of the 12 pitch classes, each frame brought to length one. Sixteen rectangular filters, summed by an integral image
of 16 frames by 12 classes, are each quantised to two bits in Gray code, and the 32 bits are packed into one integer for each frame.

Alignment: two recordings that share material have integers that are equal, or nearly so, at a constant offset. The index holds each two integers in a
row (other than two that are equal, which say nothing of time) under four keys: one half of the first with one half of the second. So a pair still
meets its fellow where the errors of either integer are in one half of it. Entries that meet are compared at once, in the join, and count as a vote if
they differ in at most NEAR of their 64 bits; chance partners, of which there are many more, end there. Votes are tallied by offset for each query and
recording, and the best offset is verified by the share of differing bits over the whole overlap, which is OVERLAP integers at least, so that the first
and the last have no frame in common. No entry has a limit: what a third of the recordings share is found too. Recordings with equal fingerprints are
one class and enter the index once; copies tells how many they are. Chance partners of a key of 32 bits still grow with the number of queries times that of recordings, though none leaves
the join; a corpus of billions of recordings would want keys of three integers.

Nulls: null, unreadable and too short media have an empty fingerprint; they are in one class of their own, and nothing aligns to them. Silence has the
fingerprint of no energy, equal integers, and so aligns only by class.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, map_batches, written

RATE, FRAME, HOP, WIDTH = 11025, 4096, 1365, 16
LOW, HIGH, STEPS = 28.0, 3520.0, (-0.3, 0.0, 0.3)
NEAR, OVERLAP, ERRORS, SLICE, AT_ONCE = 10, WIDTH, 0.2, 16, 1024
HALVES = tuple(a << 32 | b for a in (0xFFFF, 0xFFFF0000) for b in (0xFFFF, 0xFFFF0000))


@cache
def _classes() -> np.ndarray:
    """Which FFT bins add to which pitch class."""
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    heard = (bins >= LOW) & (bins <= HIGH)
    out = np.zeros((len(bins), 12))
    out[np.flatnonzero(heard), np.round(12 * np.log2(bins[heard] / 440)).astype(int) % 12] = 1
    return out


@cache
def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first class, classes, frames): the four kinds below over four bands, narrow and short to wide and long."""
    return [(kind, 3 * band, 3 if kind < 2 else 6, (4, 8, 12, 16)[(band + kind) % 4]) for kind in range(4) for band in range(4)]


def samples(media: bytes | None) -> np.ndarray:
    """One channel at RATE, between -1 and 1; empty where media can't be read."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each of length one or, without energy, zero."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    energy = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 256] * np.hanning(FRAME))) ** 2 @ _classes() for i in range(0, len(frames), 256)])
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(size > 1e-6, energy / np.maximum(size, 1e-12), 0.0)


def fingerprint(media: bytes | None) -> np.ndarray:
    """One packed 32-bit integer (as signed) for each frame that has WIDTH frames from it on."""
    c = chroma(samples(media))
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int32)
    wrapped = np.hstack([c, c[:, :6]])  # pitch classes go round
    total = np.zeros((len(c) + 1, wrapped.shape[1] + 1))
    total[1:, 1:] = wrapped.cumsum(0).cumsum(1)
    at = np.arange(n)
    box = lambda t, w, y, h: total[at + t + w, y + h] - total[at + t, y + h] - total[at + t + w, y] + total[at + t, y]
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # earlier against later
            a, b = box(0, w // 2, y, h), box(w // 2, w // 2, y, h)
        elif kind == 1:  # the middle in time against its sides
            a, b = box(w // 4, w // 2, y, h), box(0, w // 4, y, h) + box(3 * w // 4, w // 4, y, h)
        elif kind == 2:  # lower against upper classes
            a, b = box(0, w, y, h // 2), box(0, w, y + h // 2, h // 2)
        else:  # crosswise
            a, b = box(0, w // 2, y, h // 2) + box(w // 2, w // 2, y + h // 2, h // 2), box(w // 2, w // 2, y, h // 2) + box(0, w // 2, y + h // 2, h // 2)
        level = np.searchsorted(STEPS, np.round(np.log((1 + a) / (1 + b)), 9))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out.view(np.int32)


def _prints(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in media:
        yield pa.array([fingerprint(m.as_py()) for m in array], pa.list_(pa.int32()))


def chroma_print(media: Column | str) -> Column:
    return arrow_column(_prints, "array<int>", media)


def _entries(items: DataFrame) -> DataFrame:
    """items (class, print) to (class, at, two, half, key): two integers in a row as one of 64 bits, and what each of HALVES leaves of it."""
    first, second = (F.slice("print", n, F.size("print") - 1) for n in (1, 2))
    joined = F.zip_with(first, second, lambda a, b: F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))
    spots = items.filter(F.size("print") > 1).select("class", F.posexplode(joined).alias("at", "two"))
    moved = spots.filter(F.shiftrightunsigned("two", 32) != F.col("two").bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = F.array(*(F.col("two").bitwiseAND(F.lit(h if h < 1 << 63 else h - (1 << 64))) for h in HALVES))
    return moved.select("class", "at", "two", F.posexplode(keys).alias("half", "key"))


def align(prints: DataFrame, is_query: Column, id_col: str = "id") -> DataFrame:
    """prints (id, print) to (query, match, copies, offset, bit_errors, bits): for each id that is a query, the classes of recordings that align to it.

    A class is named by its smallest id; copies is how many recordings it has. Rows that repeat an id with another fingerprint are recordings of their own. offset: frames to add to the query's for the match's."""
    own = F.struct(F.xxhash64("print"), F.hash("print"))
    keyed = written(prints.select(F.col(id_col).alias("id"), is_query.alias("asks"), "print", own.alias("key")), "prints")
    each = keyed.groupBy("key").agg(F.min("id").alias("name"), F.count("*").alias("copies"), F.first("print").alias("print"), F.max("asks").alias("asks"))
    classes = written(each.withColumn("class", F.monotonically_increasing_id()), "print-classes")
    side = lambda rows, name: _entries(rows).select(F.col("class").alias(name), F.col("at").alias(f"{name}_at"), F.col("two").alias(f"{name}_two"), "half", "key")
    alike = F.bit_count(F.col("q_two").bitwiseXOR(F.col("m_two"))) <= NEAR
    asked, found = side(classes.filter("asks"), "q"), side(classes, "m")
    met = asked.join(found, (asked["half"] == found["half"]) & (asked["key"] == found["key"]) & (F.col("q") != F.col("m")) & alike)
    best = met.groupBy("q", "m", (F.col("m_at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes"))
    top = best.groupBy("q", "m").agg(F.max_by("offset", F.struct("votes", -F.abs("offset"), "offset")).alias("offset"))
    sides = top.join(classes.select(F.col("class").alias("q"), F.col("print").alias("a")), "q").join(classes.select(F.col("class").alias("m"), F.col("print").alias("b"), "copies"), "m")
    begin, end = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("a"), F.size("b") - F.col("offset"))
    span = F.greatest(F.lit(0), end - begin)
    wrong = F.aggregate(F.zip_with(F.slice("a", begin + 1, span), F.slice("b", begin + F.col("offset") + 1, span), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, x: s + x)  # bit_count widens a negative int by 32 ones
    checked = sides.withColumn("bits", 32 * span).filter(F.col("bits") >= 32 * OVERLAP).withColumn("bit_errors", wrong).filter(F.col("bit_errors") <= ERRORS * F.col("bits"))
    itself = classes.filter("asks").select(F.col("class").alias("q"), F.col("class").alias("m"), "copies", F.lit(0).alias("offset"), F.lit(0).alias("bit_errors"), (32 * F.size("print")).alias("bits"))
    pairs = written(checked.select("q", "m", "copies", "offset", "bit_errors", "bits").unionByName(itself), "aligned")
    asking = keyed.filter("asks").join(classes.select("key", F.col("class").alias("q")), "key").select(F.col("id").alias("query"), "q")
    return asking.join(pairs, "q").join(classes.select(F.col("class").alias("m"), F.col("name").alias("match")), "m").select("query", "match", "copies", "offset", "bit_errors", "bits")


def to_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x if x.dtype == np.int16 else np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return sink.getvalue()


@cache
def _notes() -> np.ndarray:
    """PCM samples of the notes from two octaves below to two above 440 Hz."""
    t = np.arange(HOP) / RATE
    return (0.5 * np.sin(2 * np.pi * 440 * 2 ** (np.arange(-24, 25)[:, None] / 12) * t) * 32767).astype("<i2")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few recordings each, as one batch of them all would be more than a task can hold."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part, out = batch.slice(i, SLICE), []
            for v in part["vector"].to_pylist():
                notes = None if v is None else np.round(np.clip(np.nan_to_num(np.array([x or 0.0 for x in v], float)), -0.5, 0.5) * 48).astype(int)
                out.append(None if v is None else to_wav(_notes()[notes + 24].ravel()))
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(out, pa.binary())], ["id", "media"])


def render(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, media). Test media: the tables hold no audio, so each vector is played as one note for each of its numbers, AT_ONCE vectors a task. A null vector has no media."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return map_batches(rows.repartition(max(1, -(-rows.count() // AT_ONCE)), "id"), _render, "id bigint, media binary")
