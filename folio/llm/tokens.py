"""Token ids of many texts by the ``tokenizers`` library, with a bounded table of cuts seen before.

Texts are cut only where a tokenizer's own splitting rule cuts too, so that ids of the cuts, in a row, are
the ids of the text. Cuts are found over the UTF-8 bytes of many texts at once. The library encodes a cut once; from
then on it is looked up by its bytes, all of which are compared, and its ids are gathered by place.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from . import textnum as X

#: Longer cuts, in bytes, are encoded anew each time.
LONGEST_KEPT = 48
#: Bytes of the table of cuts in one Python worker; a full one starts anew.
MOST_BYTES = 32 << 20
#: A text beyond so many bytes is worked on in parts.
PART_BYTES = 1 << 20

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of white space beyond ASCII: U+0085 and U+00A0; U+1680; U+2000 to U+200A, U+2028, U+2029, U+202F and U+205F; U+3000.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters, digits and other signs of ASCII; 0: white space and all beyond.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:128] = 3
_CLASS[_ASCII_SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_APOSTROPHE = 0x27
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Unicode white space."""
    out = _ASCII_SPACE[data]
    at = np.flatnonzero(_LEADS[data])
    if len(at):
        more = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = more[at], more[at + 1], more[at + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        for k, of in ((0, two | three), (1, two | three), (2, three)):
            out[at[of] + k] = True
    return out


def _changes(data: np.ndarray) -> np.ndarray:
    """Before which bytes a letter, digit or sign follows one of another kind: rules split there, but for letters behind an apostrophe."""
    kind = _CLASS[data]
    # Latin letters of two bytes, U+00C0 to U+00FF but for the signs of times and division.
    two = np.flatnonzero(data == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = 1
    out = np.zeros(len(data), dtype=bool)
    a, b = kind[:-1], kind[1:]
    out[1:] = (a > 0) & (b > 0) & (a != b) & ~((data[:-1] == _APOSTROPHE) & (b == 1))
    return out


def byte_level(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of cuts, and which may be joined by SEPARATOR. A cut is a run without white space, with one space before
    it if there is one, or white space before that; where a word follows, the last character of white space is a cut of its own.
    Runs are cut further where letters, digits and signs meet.
    """
    n = len(data)
    space = _spaces(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = edge[n] = True
    new = edge.copy()
    new[1:n] |= space[1:] != space[:-1]
    new[:n] |= _changes(data)
    ends = np.flatnonzero(new[1:] & space & ~edge[1:]) + 1
    final = data[ends - 1]
    size = np.where(final < 0x80, 1, np.where(data[ends - 2] == 0xC2, 2, 3))
    new[ends - size] = True
    new[ends[final == 0x20]] = False
    begin = np.flatnonzero(new[:n])
    end = np.append(begin[1:], n)[: len(begin)]
    return begin, end, ~space[end - 1]


def word_end(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of runs without spaces and line breaks, which have no ids, cut further where letters, digits and signs meet."""
    inside = np.concatenate([[False], (data != 0x20) & (data != 0x0A), [False]])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = at[1:-1]
    both = np.concatenate([edges[inside[edges] & inside[edges + 1]], np.flatnonzero(_changes(data))])
    begins[both] = ends[both] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    marks = np.concatenate([[0], np.cumsum(data == 1)])
    return begin, end, marks[begin] == marks[end]


CUTS = {"byte_level": byte_level, "word_end": word_end}
#: Between cuts that are encoded together: it has one id, which no cut that may be joined has.
SEPARATOR = {"byte_level": "\n", "word_end": " \x01 "}
#: Cuts that are encoded together.
JOINED = 64


class _Known:
    """Cuts of up to LONGEST_KEPT bytes as rows of 8-byte numbers, their ids in one array, and open addressing over both."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n = self.n_words = self.n_ids = 0
        self.hash, self.size, self.word = np.empty(1024, np.uint64), np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.first, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.words, self.ids = np.empty(4096, np.uint64), np.empty(4096, np.uint32)
        self._slots(12)

    def _slots(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self._place(np.arange(self.n, dtype=np.int32))

    def _place(self, todo: np.ndarray) -> None:
        at = ((self.hash[todo] * _A) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # the last of several at one slot stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def bytes(self, cuts: int = 0, words: int = 0) -> int:
        """Of the table with so many more cuts, each of two ids, and words."""
        return (self.n + cuts) * 56 + (self.n_words + words) * 8 + (self.n_ids + 2 * cuts) * 4

    def _grown(self, name: str, n: int) -> np.ndarray:
        have = getattr(self, name)
        if len(have) < n:
            more = np.empty(max(n, len(have) * 3 // 2), have.dtype)
            more[: len(have)] = have
            setattr(self, name, have := more)
        return have

    def find(self, cut: _Cuts, of: np.ndarray) -> np.ndarray:
        """Of cuts ``of``: their row, or -1."""
        out = np.full(len(of), -1, dtype=np.int64)
        hashes, todo = cut.hash[of], np.arange(len(of))
        at = ((hashes * _A) >> self.shift).astype(np.int64)
        while len(todo):
            got = self.slot[at]
            there = got >= 0
            todo, at, got = todo[there], at[there], got[there]
            hit = self.hash[got] == hashes[todo]
            out[todo[hit]] = got[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & self.mask
        # Equal hashes are not enough: sizes and all bytes must agree.
        hit = np.flatnonzero(out >= 0)
        row, own = out[hit], of[hit]
        wrong = self.size[row] != cut.size[own]
        k = 0
        live = np.flatnonzero(~wrong)
        while len(live):
            wrong[live] |= self.words[self.word[row[live]] + k] != cut.word(own[live], k)
            k += 1
            live = live[cut.size[own[live]] > 8 * k]
        out[hit[wrong]] = -1
        return out

    def add(self, cut: _Cuts, of: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, a = len(of), self.n
        sizes = cut.size[of]
        words = np.maximum(-(-sizes // 8), 1)
        for name, values in (("hash", cut.hash[of]), ("size", sizes), ("word", self.n_words + np.cumsum(words) - words), ("first", self.n_ids + np.cumsum(counts) - counts), ("count", counts)):
            self._grown(name, a + n)[a : a + n] = values
        into = self._grown("words", self.n_words + int(words.sum()))
        for k in range(int(words.max(initial=0))):
            some = np.flatnonzero(words > k)
            into[self.word[a + some] + k] = cut.word(of[some], k)
        self.push(ids)
        self.n, self.n_words, self.n_ids = a + n, self.n_words + int(words.sum()), self.n_ids + int(counts.sum())
        if 2 * self.n > len(self.slot):
            self._slots((4 * self.n).bit_length())
        else:
            self._place(np.arange(a, self.n, dtype=np.int32))

    def push(self, ids: np.ndarray) -> None:
        """Puts ids behind the known ones; they are known only once ``n_ids`` is raised."""
        self._grown("ids", self.n_ids + len(ids))[self.n_ids : self.n_ids + len(ids)] = ids


class _Cuts:
    """Cuts of a part: begin, size in bytes and a hash of each, and its bytes by eights."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, joins: np.ndarray):
        self.data, self.begin, self.size, self.joins = data, begin, end - begin, joins
        padded = np.zeros(-(-len(data) // 8) * 8 + LONGEST_KEPT + 16, np.uint8)
        padded[: len(data)] = data
        n = len(padded) // 8 - 1
        self._eights = np.empty(8 * n, np.uint64)  # the eight bytes from each place on
        for k in range(8):
            self._eights[k::8] = np.frombuffer(padded, "<u8", n, k)
        self.short = np.flatnonzero(self.size <= LONGEST_KEPT)
        self.hash = np.zeros(len(begin), np.uint64)
        of, h, k = self.short, self.size[self.short].astype(np.uint64) * _B, 0
        self.hash[of] = h
        while len(of):
            h = (self.hash[of] ^ self.word(of, k)) * _A
            self.hash[of] = (h ^ (h >> np.uint64(29))) * _B
            k += 1
            of = of[self.size[of] > 8 * k]
        self.hash ^= self.hash >> np.uint64(32)

    def word(self, of: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of cuts ``of``, zeros behind their end."""
        return self._eights[self.begin[of] + 8 * k] & _MASKS[np.minimum(self.size[of] - 8 * k, 8)]

    def texts(self, of: np.ndarray) -> list[str]:
        raw, begin = self.data.tobytes(), self.begin[of]
        return [raw[a:b].decode("utf-8") for a, b in zip(begin.tolist(), (begin + self.size[of]).tolist(), strict=True)]


class Encoder:
    """``tokenizer``: a file's name in ``public_tokenizers``, or a path. ``kind``: a key of ``CUTS``."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, tokenizer: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.lib = Tokenizer.from_file(tokenizer)
        self.lib.encode_special_tokens = True
        self.cuts, self.known, self.separator = CUTS[kind], _Known(), SEPARATOR[kind]
        (self.separator_id,) = self.lib.encode(self.separator.strip(" "), add_special_tokens=False).ids

    @classmethod
    def of(cls, tokenizer: str, kind: str) -> Encoder:
        """One for each worker and tokenizer; it outlives a task."""
        key = (tokenizer, kind)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _library(self, cut: _Cuts, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts ``of`` in a row, and how many each has."""
        joins = cut.joins[of]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        texts, n_joined = cut.texts(of[order]), int(joins.sum())
        parts = [texts[a : min(a + JOINED, n_joined)] for a in range(0, n_joined, JOINED)]
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def alone(texts: list[str]) -> None:
            got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.uint32, int(counts[-1].sum())))

        for a in range(0, len(parts), 100):
            some = parts[a : a + 100]
            for part, e in zip(some, self.lib.encode_batch_fast([self.separator.join(p) for p in some], add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                places = np.flatnonzero(got == self.separator_id)
                if len(places) != len(part) - 1:
                    alone(part)
                    continue
                counts.append(np.diff(np.concatenate([[-1], places, [len(got)]])) - 1)
                ids.append(np.delete(got, places))
        for a in range(n_joined, len(texts), 5_000):
            alone(texts[a : a + 5_000])
        flat = np.concatenate([np.empty(0, np.uint32), *ids])
        if n_joined == len(texts):
            return flat, np.concatenate([np.empty(0, np.int64), *counts])
        # Back into the order that was asked for.
        count = np.empty(len(of), np.int64)
        count[order] = np.concatenate(counts)
        first = np.empty(len(of), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        stop = np.cumsum(count)
        return flat[np.repeat(first - stop + count, count) + np.arange(len(flat))], count

    def flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of ``textnum.flat`` in one array, and the n + 1 places where rows begin and end."""
        if len(data) <= 2 * PART_BYTES:
            return self._part(data, at)
        ids, counts = [], np.zeros(len(at) - 1, np.int64)
        for row in range(len(at) - 1):
            text, start = data[at[row] : at[row + 1]], 0
            while start < len(text) or not len(text):
                stop = self._stop(text, start)
                own, _ = self._part(text[start:stop], np.array([0, stop - start]))
                ids.append(own)
                counts[row] += len(own)
                start = stop
                if not len(text):
                    break
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _stop(text: np.ndarray, start: int) -> int:
        """The first place from PART_BYTES on where a space follows an ASCII character that is none: every kind cuts there."""
        at = start + PART_BYTES
        while at < len(text):
            part = text[at - 1 : at + PART_BYTES]
            found = np.flatnonzero((part[1:] == 0x20) & (part[:-1] < 0x80) & ~_ASCII_SPACE[part[:-1]])
            if len(found):
                return at + int(found[0])
            at += PART_BYTES
        return len(text)

    def _part(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut, known = _Cuts(data, *self.cuts(data, at)), self.known
        begin = cut.begin
        row = np.full(len(begin), -1, dtype=np.int64)
        row[cut.short] = known.find(cut, cut.short)
        new = cut.short[row[cut.short] < 0]
        if len(new):
            once = new[np.unique(cut.hash[new], return_index=True)[1]]
            if known.bytes(len(once), int((cut.size[once] // 8 + 1).sum())) > MOST_BYTES:
                known.clear()
                new = cut.short
                once = new[np.unique(cut.hash[new], return_index=True)[1]]
            known.add(cut, once, *self._library(cut, once))
            row[new] = known.find(cut, new)
        # What is left is long, or shares its hash with a cut of other bytes.
        rest = np.flatnonzero(row < 0)
        first, count = known.first[row], known.count[row]
        if len(rest):
            own, count[rest] = self._library(cut, rest)
            known.push(own)
            first[rest] = known.n_ids + np.cumsum(count[rest]) - count[rest]
        stop = np.cumsum(count)
        ids = known.ids[np.repeat(first - stop + count, count) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begin, at)]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text. Null: none."""
        ids, at = self.flat(*X.flat(pa.array(list(texts), pa.string())))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``Encoder.flat``'s ids with ``end_id`` behind each row."""
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
