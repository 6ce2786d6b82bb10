"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

The contracts define words by ASCII classes, so bytes give the same words as code points would.
A word's 64-bit hash is a polynomial over random values of its bytes, then mixed; it is the same on
every machine. Two different words share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import lean, tidy

#: Bytes of text that are worked on together; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of language scoring and shingles: runs of all but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of licence and benchmark matching: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * PIECE_BYTES:
            _powers[name] = have
    return have[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 places where its rows begin and end. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about ``limit`` bytes of text, each with ``flat()`` of its text column."""
    lean()
    for batch in batches:
        data, at = flat(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            end = min(end, n)
            yield batch.slice(start, end - start), data[at[start] : at[end]], at[start : end + 1] - at[start]
            start = end
        del batch, data, at
    tidy()


@dataclass
class Words:
    """The words of a piece in reading order."""

    data: np.ndarray  #: lower-cased bytes
    at: np.ndarray  #: where rows begin and end in ``data``
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: behind its last byte
    row: np.ndarray  #: row of each word
    first: np.ndarray  #: n + 1: words before each row

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, head: int | None = None) -> np.ndarray:
        """A hash a word, or of its first ``head`` bytes; a word that is no longer keeps its own."""
        n, end = len(self.data), self.end if head is None else np.minimum(self.end, self.start + head)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.data] * _power("up", _MULTIPLIER, n), out=total[1:])
        raw = (total[end] - total[self.start]) * _power("down", _INVERSE, n + 1)[self.start]
        return mix(raw + (end - self.start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    data = LOWER[data]
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    return Words(data, at, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def hash_word(word: str, kind: np.ndarray = NOT_SPACE) -> int:
    """The hash that ``Words.hashes`` gives this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    found = words(raw, np.array([0, len(raw)]), kind)
    if len(found.start) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(found.hashes()[0])


def hash_words(text: str, kind: np.ndarray = NOT_SPACE) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), kind).hashes()


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


class Lookup:
    """Open addressing over fixed 64-bit keys: the index of each key, or -1. All probes are numpy calls."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, dtype=np.uint64)
        bits = max(4, (len(keys) * 8 // 5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = keys
        for a in range(0, len(keys), 250_000):  # so that building takes little more than the table
            todo = np.arange(a, min(a + 250_000, len(keys)), dtype=np.int32)
            at = self._home(keys[todo])
            while len(todo):
                free = self.slot[at] < 0
                self.slot[at[free]] = todo[free]  # the last of several at one slot stays
                lost = self.slot[at] != todo
                todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at = self._home(keys)
        got = self.slot[at]
        open_ = np.flatnonzero(got >= 0)
        hit = self.keys[got[open_]] == keys[open_]
        out[open_[hit]] = got[open_[hit]]
        todo = open_[~hit]
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slot[at]
            there = got >= 0
            todo, at, got = todo[there], at[there], got[there]
            hit = self.keys[got] == keys[todo]
            out[todo[hit]] = got[hit]
            todo, at = todo[~hit], at[~hit]
        return out
