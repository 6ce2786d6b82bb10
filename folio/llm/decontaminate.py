"""Benchmark items in documents, within an edit budget, by the pigeonhole rule.

Symbols are words (digits, letters and everything beyond ASCII) whose case is folded by Unicode. An item of m words may have k = m *
rate edits, rounded down: k errors leave one of k + 1 pieces intact, so each document that holds the item
holds a piece word for word. Pieces are found by hash; around each hit, the item is aligned with Myers'
bit-parallel algorithm (1999), free to begin and end anywhere in the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as X
from .common import modest

RATE = 0.25
#: Items that are searched for together. A larger benchmark is searched for in blocks, each over all documents.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000


def budget(words: int, rate: float = RATE) -> int:
    return int(words * rate)


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat()`` of texts without their case. To upper case first, as it joins letters that folding alone keeps apart (i without a dot).

    Letters become letters, so words stay where they are. Bytes that are not UTF-8 stay as they are.
    """
    if not len(data) or int(data.max()) < 128:
        return data, at  # A to Z is left to ``words``
    raw = data.tobytes()
    rows = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    rows = [x if x.isascii() else x.decode("utf-8", "surrogateescape").upper().casefold().encode("utf-8", "surrogateescape") for x in rows]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


def item_words(text: str) -> np.ndarray:
    """Hashes of an item's words."""
    return X.words(*folded(*X.flat(pa.array([text], pa.string()))), X.ALNUM).hashes()


def _chain(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    code = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        code = code * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
    return X.mix(code + np.uint64(size))


@dataclass
class Items:
    """A block of items and the index of their pieces."""

    ids: list[int]
    words: list[np.ndarray]
    rate: float = RATE

    def __post_init__(self):
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, own in enumerate(self.words):
            k = budget(len(own), self.rate)
            cuts = [len(own) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    code = int(_chain(own, np.array([a]), b - a)[0])
                    found.setdefault(b - a, {}).setdefault(code, []).append((t, a))
        #: By length of pieces: the lookup, and for each of its keys the items and places.
        self.pieces = {size: (X.Lookup(np.array(list(by), dtype=np.uint64)), list(by.values())) for size, by in found.items()}
        self.masks = [None] * len(self.words)

    def mask(self, t: int) -> dict[int, int]:
        if self.masks[t] is None:
            own: dict[int, int] = {}
            for i, w in enumerate(self.words[t].tolist()):
                own[w] = own.get(w, 0) | 1 << i
            self.masks[t] = own
        return self.masks[t]

    def hits(self, h: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(row, item): where in ``h`` the item would begin if it had no insertions or deletions before its piece."""
        out: dict[tuple[int, int], list[int]] = {}
        for size, (lookup, held) in self.pieces.items():
            at = np.arange(max(len(h) - size + 1, 0))
            got = lookup.find(_chain(h, at, size))
            at = at[got >= 0]
            at = at[row[at] == row[at + size - 1]]
            for b, key in zip(at.tolist(), got[at].tolist(), strict=True):
                for t, place in held[key]:
                    out.setdefault((int(row[b]), t), []).append(b - place)
        return out

    def best(self, t: int, begins: list[int], h: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """Smallest distance of item t around ``begins`` within words low to high, and the word behind its first such end."""
        m, k = len(self.words[t]), budget(len(self.words[t]), self.rate)
        found, done = None, low
        begins = sorted(set(begins))
        i = 0
        while i < len(begins):
            a, b = begins[i] - k, begins[i] + m + k
            while i + 1 < len(begins) and begins[i + 1] - k <= b:
                i += 1
                b = begins[i] + m + k
            i += 1
            a, b = max(a, low, done - m - k), min(b, high)
            distance, end = search(self.mask(t), m, h[a:b].tolist())
            if distance <= k and (found is None or distance < found[0]):
                found = (distance, a + end)
            done = b
        return found


def search(mask: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Myers: smallest edit distance of a pattern to any stretch of ``text``, and the place behind its first end. One step a word, whatever m."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        hp = (minus | ~(d | plus)) & full
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = (hm | ~(x | hp)) & full, hp & x
        if score < best:
            best, end = score, j
    return best, end


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[Items]:
    """Streams the items; one block at a time is on the driver."""
    ids, words, total = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        own = item_words(r.text or "")
        if not len(own):
            continue
        ids.append(r.item_id), words.append(own)
        total += len(own)
        if len(ids) >= BLOCK_ITEMS or total >= BLOCK_WORDS:
            yield Items(ids, words, rate)
            ids, words, total = [], [], 0
    if ids:
        yield Items(ids, words, rate)


MATCHES = "doc_id long, item_id long, distance long, item_words long, stop_word long"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) rows: doc_id, item_id, distance, item_words, stop_word.

    A row for each pair of ids within the budget, with the smallest distance and the word (from 0) behind the item's first such end.
    Case does not count, in any script. Null and empty texts, and items without words, match nothing; rows that share an id count as one; items and
    texts may be of any length, as bit vectors grow with an item's words; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    modest(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for items in _blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast((items.ids, items.words))  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, rate)
            for batch, data, at in X.pieces(batches):
                w = X.words(*folded(data, at), X.ALNUM)
                h, doc, rows = w.hashes(), batch.column("doc_id").to_pylist(), []
                for (r, t), begins in items.hits(h, w.row).items():
                    if found := items.best(t, begins, h, int(w.first[r]), int(w.first[r + 1])):
                        rows.append((doc[r], items.ids[t], found[0], len(items.words[t]), found[1] - int(w.first[r])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "distance", "item_words", "stop_word"])

        out = out.unionByName(narrow.mapInArrow(run, MATCHES))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "stop_word", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.distance", "best.item_words", "best.stop_word")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item within its budget. Each row is judged where it is scanned, by its
    own text: rows without doc_id and repeated ones too. Null and empty texts stay; columns of any name are carried along.
    """
    spark = docs.sparkSession
    modest(spark)
    if "text" not in docs.columns:
        raise ValueError("no column text")
    schema = docs.schema
    for items in _blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast((items.ids, items.words))  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, rate)
            for batch, data, at in X.pieces(batches):
                w = X.words(*folded(data, at), X.ALNUM)
                h, keep = w.hashes(), np.ones(batch.num_rows, dtype=bool)
                for (r, t), begins in items.hits(h, w.row).items():
                    if keep[r] and items.best(t, begins, h, int(w.first[r]), int(w.first[r + 1])):
                        keep[r] = False
                if keep.any():
                    yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
