"""Token files with directly addressable codes (DACs).

Each id is split into chunks of fixed widths, lowest first. Level k holds chunk k of every id that has one,
a bitmap telling which of these ids go on to level k + 1, and a rank directory: set bits before each block of
512. So any id is found from its position by a rank a level, with no block to decode.

File format: a Parquet table of segments, a row each: shard, segment, ids_before (in its shard), n_ids,
doc_ids, doc_lengths, payload. A segment holds whole documents. payload, little-endian: "DAC1", u8 levels, u8 width of each level, then for
each level u64 ids in it, and its arrays: chunks (u8 or u16), bitmap (u64 words), ranks (u32), the last two
not on the last level. Shards ascend in doc_id, and so do segments and the documents in them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textnum as X
from .common import written
from .tokens import Encoder, with_end

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_IDS = 1 << 20
SEGMENTS = "shard int, segment int, ids_before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def encode(ids: np.ndarray, widths: tuple[int, ...] = (8, 8)) -> bytes:
    """Widths: 8 or 16 bits a level; together as many as the largest id needs."""
    out = [MAGIC, struct.pack(f"<{1 + len(widths)}B", len(widths), *widths)]
    rest = ids.astype(np.uint64)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError(f"ids need more than {sum(widths)} bits")
    for k, width in enumerate(widths):
        out.append(struct.pack("<Q", len(rest)))
        out.append((rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}").tobytes())
        if k + 1 < len(widths):
            rest = rest >> np.uint64(width)
            more = rest > 0
            words = -(-len(rest) // BLOCK) * (BLOCK // 64)
            bits = np.zeros(words * 64, dtype=bool)
            bits[: len(rest)] = more
            out.append(np.packbits(bits, bitorder="little").tobytes())
            ones = bits.reshape(-1, BLOCK).sum(axis=1)
            out.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            rest = rest[more]
    return b"".join(out)


class Reader:
    """Random access into an encoded payload; arrays are views, nothing is decoded before it is asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC payload")
        n = payload[4]
        self.widths, at, self.levels = tuple(payload[5 : 5 + n]), 5 + n, []
        for k, width in enumerate(self.widths):
            (size,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, f"<u{width // 8}", size, at + 8)
            at += 8 + chunks.nbytes
            bitmap = ranks = None
            if k + 1 < n:
                blocks = -(-size // BLOCK)
                bitmap = np.frombuffer(payload, "<u8", blocks * (BLOCK // 64), at)
                ranks = np.frombuffer(payload, "<u4", blocks, at + bitmap.nbytes)
                at += bitmap.nbytes + ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, in any order."""
        at = np.asarray(positions, dtype=np.int64)
        out, own, shift = np.zeros(len(at), dtype=np.uint64), np.arange(len(at)), 0
        for (chunks, bitmap, ranks), width in zip(self.levels, self.widths, strict=True):
            out[own] |= chunks[at].astype(np.uint64) << np.uint64(shift)
            shift += width
            if bitmap is None:
                break
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            goes = (bitmap[word] >> bit) & np.uint64(1) > 0
            own, at, word, bit = own[goes], at[goes], word[goes], bit[goes]
            rank = ranks[at // BLOCK].astype(np.int64) + np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            first = at // BLOCK * (BLOCK // 64)
            for back in range(1, BLOCK // 64):
                before = word - back
                inside = before >= first
                rank[inside] += np.bitwise_count(bitmap[before[inside]])
            at = rank
        return out.astype(np.uint32)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids at start to stop - 1. Only the first position of each level needs a rank; the rest follow it."""
        out, own, shift = np.zeros(stop - start, dtype=np.uint32), None, 0
        for (chunks, bitmap, ranks), width in zip(self.levels, self.widths, strict=True):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if own is None:
                out |= part
            else:
                out[own] |= part
            shift += width
            if bitmap is None or start == stop:
                break
            first = start // 64
            bits = np.unpackbits(bitmap[first : -(-stop // 64)].view(np.uint8), bitorder="little")[start - 64 * first : stop - 64 * first].astype(bool)
            block = start // BLOCK
            inside = bitmap[block * (BLOCK // 64) : first]
            before = int(ranks[block]) if block < len(ranks) else 0
            before += int(np.bitwise_count(inside).sum())
            if start % 64:
                before += int(np.bitwise_count(bitmap[first] & np.uint64((1 << start % 64) - 1)))
            goes = np.flatnonzero(bits)
            own = goes if own is None else own[goes]
            start, stop = before, before + len(goes)
        return out


def write_segments(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", kind: str = "word_end", end_id: int = 2, widths: tuple[int, ...] = (8, 8), segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order.

    Null and empty texts are the end id alone. Rows that share a doc_id stay separate documents, ordered by a hash
    of their text and then the text. An empty table gives no segments. Null doc_ids come first. A very long text makes a longer
    segment; one whose codes exceed the 2 GB of a binary cell is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment, before = Encoder.of(tokenizer, kind), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, before
            all_ids = np.concatenate(ids)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([len(all_ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([encode(all_ids, widths)], pa.binary())], names=["shard", "segment", "ids_before", "n_ids", "doc_ids", "doc_lengths", "payload"])
            segment, before = segment + 1, before + len(all_ids)
            ids.clear(), doc_ids.clear(), lengths.clear()
            return row

        total = 0
        for batch, data, at in X.pieces(batches):
            own, places = with_end(*encoder.flat(data, at), end_id)
            names, sizes, row = batch.column("doc_id").to_pylist(), np.diff(places), 0
            while row < len(names):
                # Up to the document with which the segment is large enough.
                stop = min(int(np.searchsorted(places, places[row] + segment_ids - total)), len(names))
                ids.append(own[places[row] : places[stop]])
                doc_ids += names[row:stop]
                lengths += sizes[row:stop].tolist()
                total += int(places[stop] - places[row])
                row = stop
                if total >= segment_ids:
                    yield close()
                    total = 0
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    # Whole texts are no range keys: those are sampled to the driver and sent to each task.
    ordered = ordered.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def read_documents(segments: DataFrame, function=None, column: str = "ids binary") -> DataFrame:
    """Documents of a segment table: doc_id, start, n_tokens and ``function(ids)``, by default the ids as little-endian unsigned 32-bit integers."""
    name = column.split()[0]
    kind = {"binary": pa.binary(), "long": pa.int64(), "bigint": pa.int64()}[column.split()[1]]
    function = function or (lambda ids: ids.astype("<u4").tobytes())
    # A row a shard: few enough for one window and a broadcast at any size.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    shards = shards.select("shard", (F.sum("all_ids").over(W.Window.orderBy("shard")) - F.col("all_ids")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader, at = Reader(batch.column("payload")[k].as_py()), int(batch.column("seg_start")[k].as_py())
                doc_ids, lengths = batch.column("doc_ids")[k].values, batch.column("doc_lengths")[k].values.to_numpy()
                stops = np.cumsum(lengths)
                values = [function(reader.range(b - n, b)) for n, b in zip(lengths.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at + stops - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", name])

    placed = segments.join(F.broadcast(shards), "shard").select("doc_ids", "doc_lengths", "payload", (F.col("shard_start") + F.col("ids_before")).alias("seg_start"))
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_file(docs: DataFrame, **options) -> DataFrame:
    """``write_segments`` stored in the shared folder."""
    return written(write_segments(docs, **options), "dac")
