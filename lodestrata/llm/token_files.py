"""Token ids of whole documents in binary files of independent zstandard frames with a seek table at the end.

A file holds the documents of one range of ids, in order. Ids are little-endian unsigned 32-bit integers, an end id after each document. A frame
takes documents until it has FRAME ids or more and ends with the last of them; what is longer than two frames is parted evenly over frames of FRAME ids or more. After the frames stand two skippable frames:
the directory (ids, null marks and token counts of the documents) and the seek table of the public zstd seekable format, with the low 32 bits of
XXH64 of each frame's content as its checksum. A reader that wants some documents decompresses the frames they are in and checks those.

Files are written under a name of their own for each attempt and then renamed, so a retried or speculative task leaves one whole file. Each
task streams: it holds one frame and the directory of its own file.

Nulls: a null text is the empty text (one end id); null ids come first. Rows with equal ids stay in the order of their texts; an id that very many rows share is parted over files by how its texts begin. Ids are whole numbers; an id that
isn't one is an error. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch_path, written
from .tokenizing import default_tokenizer, encoder, portions

FRAME, LEVEL, BEGINNING = 1 << 16, 1, 64
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
IDS = np.dtype("<u4")


class Writer:
    """One file, written through from first to last."""

    def __init__(self, sink) -> None:
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.waiting, self.frames = 0, []
        self.ids: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _frame(self, part: np.ndarray) -> None:
        raw = part.tobytes()
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.waiting:
            tokens = np.concatenate(self.held)
            for part in np.array_split(tokens, max(1, len(tokens) // FRAME)):
                self._frame(part)
            self.held, self.waiting = [], 0

    def add(self, ids: np.ndarray, valid: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        """Documents with these ids, their tokens from at[i] to at[i + 1]."""
        self.ids.append(ids)
        self.valid.append(valid)
        self.sizes.append(np.diff(at))
        begin = at[0]
        for end in at[1:]:
            if self.waiting + end - begin >= FRAME:
                self.held.append(tokens[begin:end].astype(IDS))
                self.waiting += end - begin
                self._flush()
                begin = end
        self.held.append(tokens[begin : at[-1]].astype(IDS))
        self.waiting += at[-1] - begin

    def close(self) -> tuple[int, int]:
        """The numbers of documents and of ids."""
        self._flush()
        ids, valid, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.valid, self.sizes))
        listing = struct.pack("<Q", len(ids)) + ids.astype("<i8").tobytes() + sizes.astype("<u8").tobytes() + valid.astype("u1").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(listing)) + listing)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        return len(ids), int(sizes.sum())


class Reader:
    """Opens a file by its end: seek table, then directory, then only the frames that are asked for."""

    def __init__(self, file) -> None:
        self.file, self.zstd, self.read = file, zstandard.ZstdDecompressor(), 0
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        seek = size - 9 - 12 * n - 8
        entries = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self.bounds = np.concatenate(([0], np.cumsum(entries[:, 1]))) // IDS.itemsize
        self.sums = entries[:, 2]
        listing = self._at(self.places[-1] + 8, seek - self.places[-1] - 8)
        (m,) = struct.unpack_from("<Q", listing)
        self.ids, sizes = np.frombuffer(listing, "<i8", m, 8), np.frombuffer(listing, "<u8", m, 8 + 8 * m).astype(np.int64)
        self.valid = np.frombuffer(listing, "u1", m, 8 + 16 * m).astype(bool)
        self.at = np.concatenate(([0], np.cumsum(sizes)))

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(int(size), int(place))

    def frame(self, i: int) -> np.ndarray:
        raw = self.zstd.decompress(self._at(self.places[i], self.places[i + 1] - self.places[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} fails its checksum")
        self.read += 1
        return np.frombuffer(raw, IDS)

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """The ids of the file from begin up to end."""
        i, j = np.searchsorted(self.bounds, begin, "right") - 1, np.searchsorted(self.bounds, end, "left")
        parts = [self.frame(k) for k in range(i, j)]
        return np.concatenate(parts)[begin - self.bounds[i] : end - self.bounds[i]] if parts else np.zeros(0, IDS)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document with that id."""
        return [self.tokens(self.at[i], self.at[i + 1]) for i in np.flatnonzero((self.ids == doc_id) & self.valid)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of its first token in the file, tokens) of all documents, each frame decompressed once."""
        held, since, k = np.zeros(0, IDS), 0, 0
        for i, (doc_id, ok) in enumerate(zip(self.ids.tolist(), self.valid.tolist(), strict=True)):
            begin, end = int(self.at[i]), int(self.at[i + 1])
            parts = [held[begin - since :]]
            while self.bounds[k] < end:
                parts.append(self.frame(k))
                k += 1
            held, since = np.concatenate(parts), begin
            yield (doc_id if ok else None), begin, held[: end - begin]


def with_end(tokens: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document."""
    return np.insert(tokens.astype(IDS), at[1:], end_id), at + np.arange(len(at))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names for S3 are read as s3."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else folder)


def _write(folder: str, tokenizer: str, end_id: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        shard = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{shard:06d}.ids.zst", f"{root}/.draft-{shard:06d}-{uuid.uuid4().hex}"
        writer = None
        for batch in batches:
            for part in portions(batch):
                if writer is None:
                    store.create_dir(root)
                    sink = store.open_output_stream(draft)
                    writer = Writer(sink)
                ids = part["id"]
                writer.add(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), *with_end(*encoder(tokenizer).encode(part["text"]), end_id))
        if writer is not None:
            docs, tokens = writer.close()
            sink.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name.rsplit("/", 1)[1]], "documents": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return each


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to folder (a URI that driver and executors share) and returns what they hold: shard, file, documents, tokens, start."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange("id", F.left("text", F.lit(BEGINNING))).sortWithinPartitions("id", "text")
    listed = written(map_batches(sorted_rows, _write(folder, tokenizer or default_tokenizer(), end_id), "shard int, file string, documents bigint, tokens bigint"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _digests(folder: str):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    rows: list[tuple] = []
                    for doc_id, at, tokens in Reader(file).documents():
                        rows.append((doc_id, start + at, len(tokens), zlib.crc32(tokens.tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return each


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(listed: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: for each document its id, the ids before it in all files, its number of ids and their crc32."""
    files = listed.select("file", "start").repartition(max(1, listed.count()))
    return map_batches(files, _digests(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return digests(write(docs, folder, tokenizer), folder)
