"""Bounded-space online packing of token sequences.

A partition keeps a fixed number of open windows of ``length`` tokens. A document's full stretches of
``length`` make windows of their own; what remains goes to the open window that it fills best. When it fits
nowhere, the fullest window is emitted; if more than ``slack`` tokens of it were still free, they are first
filled with the front of the document, which is cut there. At the end the windows left open, so many a
partition at most, are laid end to end in one order over all partitions and cut every ``length`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textnum as X
from .common import written
from .tokens import Encoder, with_end

LENGTH, OPEN, SLACK = 2048, 32, 16
PIECES = "doc_id long, doc_tokens long, start long, ids binary, part int, window long, offset long, left boolean"


class Windows:
    """The open windows of one partition. A document is anything that can be sliced; windows hold slices of it."""

    def __init__(self, length: int, most: int, slack: int):
        self.length, self.most, self.slack, self.closed = length, most, slack, 0
        self.open: list[list] = []  # free tokens, pieces

    def add(self, doc: tuple, ids, out: list) -> None:
        """Places ``ids`` of ``doc``; emitted pieces go to ``out`` as (doc, start, ids, window, offset)."""
        start, stop = 0, len(ids)
        while stop - start >= self.length:
            self._emit([0, [(doc, start, ids[start : start + self.length])]], out)
            start += self.length
        while start < stop:
            size = stop - start
            # Best fit: the least free space that is enough. Of equals, the window opened first.
            best = min((w for w in self.open if w[0] >= size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [self.length, []]
                self.open.append(best)
            if best is None:
                fullest = min(self.open, key=lambda w: w[0])
                if fullest[0] > self.slack:
                    fullest[1].append((doc, start, ids[start : start + fullest[0]]))
                    start += fullest[0]
                self.open.remove(fullest)
                self._emit(fullest, out)
                continue
            best[0] -= size
            best[1].append((doc, start, ids[start:stop]))
            if not best[0]:
                self.open.remove(best)
                self._emit(best, out)
            return

    def _emit(self, window: list, out: list) -> None:
        at = 0
        for doc, start, ids in window[1]:
            out.append((doc, start, ids, self.closed, at))
            at += len(ids)
        self.closed += 1

    def rest(self, out: list) -> None:
        """The windows left open, as one stretch."""
        at = 0
        for _, held in self.open:
            for doc, start, ids in held:
                out.append((doc, start, ids, None, at))
                at += len(ids)
        self.open = []


class _Ids:
    """A document's ids; a slice of it is a copy, so that an open window holds no more than its own."""

    __slots__ = ("raw",)

    def __init__(self, raw: bytes):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw) // 4

    def __getitem__(self, part: slice) -> _Ids:
        return _Ids(self.raw[4 * part.start : 4 * part.stop])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte_level", end_id: int = 1, length: int = LENGTH, open_windows: int = OPEN, slack: int = SLACK) -> DataFrame:
    """Packs ``docs`` (doc_id, text; other columns are ignored): a row a piece, with its ids.

    Returns doc_id, start (tokens of its document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (the end id included), sequence_id (dense from 0), offset (in the sequence). Null and empty texts are the end
    id alone; repeated rows and rows without doc_id are packed each; a text of any length is held once, as ids; of windows with
    equal space the one opened first is taken; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, windows = Encoder.of(tokenizer, kind), TaskContext.get().partitionId(), Windows(length, open_windows, slack)

        def rows(found: list) -> pa.RecordBatch:
            cols = [
                pa.array([d[0] for d, *_ in found], pa.int64()), pa.array([d[1] for d, *_ in found], pa.int64()), pa.array([s for _, s, *_ in found], pa.int64()),
                pa.array([i.raw for _, _, i, *_ in found], pa.binary()), pa.array([part] * len(found), pa.int32()),
                pa.array([w or 0 for *_, w, _ in found], pa.int64()), pa.array([o for *_, o in found], pa.int64()), pa.array([w is None for *_, w, _ in found], pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_tokens", "start", "ids", "part", "window", "offset", "left"])

        for batch, data, at in X.pieces(batches):
            ids, places = with_end(*encoder.flat(data, at), end_id)
            raw, places, found = ids.astype("<u4", copy=False).data, (4 * places).tolist(), []
            raw = memoryview(raw).cast("B")
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), places[:-1], places[1:], strict=True):
                windows.add((doc_id, (b - a) // 4), _Ids(bytes(raw[a:b])), found)
            if found:
                yield rows(found)
        found = []
        windows.rest(found)
        if found:
            yield rows(found)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = written(narrow.mapInArrow(run, PIECES), "packed")
    # Two numbers a partition: windows it emitted, tokens it left over.
    parts = placed.groupBy("part").agg(F.coalesce(F.max(F.when(~F.col("left"), F.col("window"))) + 1, F.lit(0)).alias("closed"), F.sum(F.when(F.col("left"), F.length("ids") / 4).otherwise(0)).cast("long").alias("rest"))
    every = W.Window.orderBy("part")
    parts = parts.select("part", (F.sum("closed").over(every) - F.col("closed")).alias("first"), (F.sum("rest").over(every) - F.col("rest")).alias("before"), F.sum("closed").over(W.Window.partitionBy()).alias("all_closed"))
    joined = placed.join(F.broadcast(parts), "part")
    columns = ["doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens"]
    whole = joined.filter(~F.col("left")).select(*columns, (F.col("first") + F.col("window")).alias("sequence_id"), "offset")
    # A leftover piece ends where a sequence is full and goes on in the next: cut at multiples of length.
    at, n = F.col("before") + F.col("offset"), (F.length("ids") / 4).cast("long")
    cut = joined.filter("left").withColumn("at", at).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))))
    low, high = F.greatest(F.col("at"), F.col("k") * length), F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * length)
    cut = cut.withColumn("low", low).withColumn("high", high)
    rest = cut.select("doc_id", (F.col("start") + F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"), F.expr("substring(ids, cast(4 * (low - at) + 1 as int), cast(4 * (high - low) as int))").alias("ids"), "doc_tokens", (F.col("all_closed") + F.col("k")).alias("sequence_id"), (F.col("low") - F.col("k") * length).alias("offset"))
    return whole.unionByName(rest)
