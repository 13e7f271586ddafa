"""Vectorised word splitting and hashing over Arrow string columns.

Every function works on the raw UTF-8 bytes of a column: separators are looked
up in a 256-entry table, and word hashes come from one prefix sum of a
polynomial hash, so no Python object is made for a word.  Hashes have 64 bits
and depend on nothing but the bytes of the words (after folding).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text handled at a time; a longer text is handled alone
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def give_back() -> None:
    """Returns freed memory to the system; workers live on from group to group."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _byte_codes(fold: np.ndarray) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))[fold]


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Splitter:
    """Which bytes belong to words, and how bytes are folded before hashing."""

    def __init__(self, word_bytes: np.ndarray, lower: bool) -> None:
        self.word = word_bytes
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.codes = _byte_codes(fold)


def _table(separators: list[range]) -> np.ndarray:
    word = np.ones(256, bool)
    for r in separators:
        word[list(r)] = False
    return word


#: Words of the class [^\x20\x09-\x0D]+, as they are or with A-Z lowered.
SPACED = Splitter(_table([range(0x09, 0x0E), range(0x20, 0x21)]), lower=False)
SPACED_LOWER = Splitter(_table([range(0x09, 0x0E), range(0x20, 0x21)]), lower=True)
#: Lowered words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (upper case is lowered first).
ALNUM_LOWER = Splitter(_table([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)]), lower=True)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts of the slice
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray  # of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words of text i are first[i] to first[i + 1]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes: first row, end row, bytes, offsets."""
    data, offsets = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_codes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def split(data: np.ndarray, offsets: np.ndarray, how: Splitter) -> Words:
    n = len(data)
    inside = how.word[data]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True  # a text's first byte starts a word whatever stands before it
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    h = span_hash(prefix_codes(data, how.codes), start, end)
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, whatever text they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (k * int(_STEP)) & _MASK, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    return mix(out)


def text_windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of k words that lie in one text: hash, index of the first word, text."""
    h = windows(words.hash, k)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(text[: len(h)] == text[k - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    return h[at], at, text[at]


def spread(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def counts_between(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the boolean `marks` lie in each text."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[offsets])
