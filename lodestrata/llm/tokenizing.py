"""Whole texts to token ids with a byte-level BPE of the tokenizers library.

A byte-level BPE that parts words before it merges never merges across a space or line end that stands alone between two words, so a text whose words are parted that way is the
sequence of its words' ids, and each worker asks the library for each word once (up to CACHE words are kept, then they are forgotten). Any other
text (runs of white space, other white space, special tokens) is given to the library whole, and so is every text where the file isn't of that kind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE, GROUP, AT_ONCE = 400_000, 512, 8 << 20
_SPACE, _NEWLINE = 32, 10


def _odd(data: np.ndarray, at: np.ndarray, spaced: bool = False) -> np.ndarray:
    """Positions in UTF-8 data that a text of single spaces and line ends between words doesn't have; at: where texts begin, and the end. spaced: texts begin with a space."""
    parting = (data == _SPACE) | (data == _NEWLINE)
    other = ((data >= 9) & (data <= 13) & ~parting) | ((data >= 28) & (data <= 31))
    other[1:] |= parting[1:] & parting[:-1]
    full = at[1:] > at[:-1]
    edges = at[1:][full] - 1 if spaced else np.concatenate((at[:-1][full], at[1:][full] - 1))
    other[edges] |= parting[edges]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    pad = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.concatenate((np.flatnonzero(other), lead[white]))


class Encoder:
    """Keeps the ids, as bytes, of each word met, with the space or line end before it. plain: special tokens' strings in texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        self.words: dict[bytes, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        kind = json.loads(self.library.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.by_word = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        names = self.library.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.newline = self._bytes(self.library.encode("\n", add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of new words. Words after a space are put together and their ids parted again where a token opens with a space."""
        first, rest = [w for w in new if w[:1] != b" "], [w for w in new if w[:1] == b" "]
        found = {w: (self.newline if w[:1] == b"\n" else b"") + self._bytes(ids) for w, ids in zip(first, self._batch([w.removeprefix(b"\n").decode() for w in first]), strict=True)}
        for i in range(0, len(rest), GROUP):
            group = rest[i : i + GROUP]
            array = np.array(self._batch([b"".join(group).decode()])[0], self.kind)
            starts = np.flatnonzero(self.opens[array])
            if len(starts) != len(group) or starts[0]:
                found.update(zip(group, map(self._bytes, self._batch([w.decode() for w in group])), strict=True))
                continue
            raw, at = array.tobytes(), [*(starts * self.kind.itemsize).tolist(), array.nbytes]
            found.update(zip(group, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        self.words.update(found)
        return [found[w] for w in new]

    def _plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each text's begin, of texts of single spaces and line ends between words."""
        opens = (data == _SPACE) | (data == _NEWLINE)
        opens[at[:-1][at[1:] > at[:-1]]] = True
        opens = np.flatnonzero(opens)
        offsets = np.append(opens, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opens), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes, (_, places, held) = coded.indices.to_numpy(), coded.dictionary.buffers()
        raw, places = held.to_pybytes(), np.frombuffer(places, np.int64, len(coded.dictionary) + 1).tolist()
        own = [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        parts = list(map(self.words.get, own))
        missing = [i for i, p in enumerate(parts) if p is None]
        for i, p in zip(missing, self._learn([own[i] for i in missing]), strict=True):
            parts[i] = p
        flat = np.frombuffer(b"".join(parts), self.kind)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        start = np.cumsum(size) - size
        n = size[codes]
        till = np.cumsum(n)
        ids = flat[np.repeat(start[codes] - till + n, n) + np.arange(till[-1] if len(till) else 0)]
        return ids, np.concatenate(([0], till))[np.searchsorted(opens, at)]

    def encode(self, texts: pa.Array, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts (null: empty), and where those of each text begin and the last end. spaced: every text that isn't empty begins with a space."""
        if len(self.words) > CACHE:
            self.words.clear()
        texts = texts.fill_null("").cast(pa.large_binary())
        texts = pa.concat_arrays([texts])  # no offset
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        slow = np.zeros(len(texts), bool)
        slow[np.searchsorted(at, _odd(data, at, spaced), side="right") - 1 if self.by_word else slice(None)] = True
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            slow |= np.array([any(s in whole[a:b] for s in self.special) for a, b in zip(at[:-1], at[1:], strict=True)])
        if not slow.any():
            return self._plain(data, at)
        size = np.where(slow, 0, np.diff(at))
        ids, begin = self._plain(data[~np.repeat(slow, np.diff(at))], np.concatenate(([0], np.cumsum(size))))
        odd = iter(self._batch([whole[at[i] : at[i + 1]].decode() for i in np.flatnonzero(slow)]))
        parts = [np.array(next(odd), self.kind) if s else ids[begin[i] : begin[i + 1]] for i, s in enumerate(slow)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def portions(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about AT_ONCE bytes of text."""
    size = np.cumsum(pc.binary_length(batch[text_col]).fill_null(0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + AT_ONCE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


@cache
def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker process, file and way."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, plain)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
