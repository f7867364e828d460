"""Words of whole texts as numpy arrays: one pass over the bytes of many texts.

A block is a run of texts of bounded size (or one longer text). Words, windows
of words and lines get 64-bit hashes from prefix sums of a polynomial over the
bytes, so no Python code runs per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_rng = np.random.default_rng(20240101)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SECOND = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but digits, lower-case letters and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES + 1, 1 << int(n).bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.popitem()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


@dataclass
class Block:
    """Texts first..first+n-1 of a batch; offsets are byte offsets into data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text each byte position is in."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Block(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


class Hasher:
    """64-bit hashes of byte ranges of one block; a second, independent one."""

    def __init__(self, data: np.ndarray, second: bool = False):
        self.up, self.down = powers(len(data) + 1)
        terms = (_SECOND if second else _TABLE)[data] * self.up[: len(data)]
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    text: np.ndarray  # text of each word, within the block
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray  # words of each text


def words(block: Block, data: np.ndarray, separators: np.ndarray) -> Words:
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[block.offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    text = block.text_of(start)
    return Words(text, start, end, Hasher(data).of(start, end), np.bincount(text, minlength=block.n))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words in one text."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.text[: len(w.text) - n + 1] == w.text[n - 1 :])
    return at, sequence_hash([w.hash[at + k] for k in range(n)])


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full_like(parts[0], np.uint64(len(parts)))
    for k, p in enumerate(parts):
        total = total + p * _MIX[k]
    return mix(total)
