"""Near duplicates by SuperMinHash (Ertl 2017), banding, verification on full sets and components.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Equal sets are one class. SuperMinHash
lets each element go through the components in a random order of its own; in step j it can set the j-th of
them to j + r, 0 <= r < 1. Here all elements take step j together, and a document stops once each component
holds a value below j + 1, as no later step can lower any: few steps for long texts, and the same signature.

Bands of the signature make buckets. In a bucket each class is held against two pivots, the best of which is
verified; links give components. Pairs of a bucket that are still in different components and whose
signatures agree enough are then verified too, within blocks that hold whole sets: a bucket of any size is spread
out, and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .common import forget, spread_join, tables, written
from .components import components

SHINGLE = 5
#: 40 bands of 5: of pairs with similarity 0.75, one in 50,000 shares no band.
BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
#: A pair whose signatures agree in fewer components is not verified: 5 standard deviations below 0.75.
AGREE = int(SIZE * (0.75 - 5 * (0.75 * 0.25 / SIZE) ** 0.5))
BLOCK = 500
_MASK64 = (1 << 64) - 1


def shingles(w: X.Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and n + 1 places where rows begin. Rows with fewer words: one of all of them."""
    h, n = w.hashes(), w.per_row
    whole = np.arange(max(len(h) - width + 1, 0))
    whole = whole[w.row[whole] == w.row[whole + width - 1]]
    code = np.zeros(len(whole), dtype=np.uint64)
    for j in range(width):
        code = code * np.uint64(0xD6E8FEB86659FD93) + h[whole + j]
    row = w.row[whole]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            there = n[short] > j
            own[there] = own[there] * np.uint64(0xD6E8FEB86659FD93) + h[w.first[short[there]] + j]
        code, row = np.concatenate([code, own + n[short].astype(np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        code, row = code[order], row[order]
    code, first = X.mix(code), np.searchsorted(row, np.arange(len(n) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            code[a:b].sort()
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.concatenate([[0], np.cumsum(new)])[first]


def signatures(elements: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of each row's elements: rows by ``size``, step << 24 | 24 random bits. Rows without elements: all ones."""
    out = np.full((len(first) - 1, size), 0xFFFFFFFF, dtype=np.uint32)
    start = 0
    while start < len(out):  # so many elements at once that their orders fit a few MB
        stop = max(start + 1, int(np.searchsorted(first, first[start] + 60_000, side="right")) - 1)
        _sign(elements[first[start] : first[stop]], np.repeat(np.arange(start, stop), np.diff(first[start : stop + 1])), out, size)
        start = stop
    return out


def _sign(e: np.ndarray, row: np.ndarray, out: np.ndarray, size: int) -> None:
    flat, moved = out.reshape(-1), []  # moved: component taken in each step, and what was put in its place
    order = None
    for j in range(size):
        if not len(e):
            return
        z = X.mix(e * np.uint64(0xA24BAED4963EE407) + np.uint64(j * 0x9FB21C651E98DF25 & _MASK64))
        k = (((z >> np.uint64(32)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64) + j
        value = ((z & np.uint64(0xFFFFFF)) | (np.uint64(j) << np.uint64(24))).astype(np.uint32)
        if j < 4:
            got, here = k.copy(), np.full(len(e), j)
            for taken, put in moved:
                got = np.where(k == taken, put, got)
                here = np.where(taken == j, put, here)
            moved.append((k, here))
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.int16), (len(e), 1))
                at = np.arange(len(e))
                for taken, put in moved:
                    order[at, taken] = put
            at = np.arange(len(e))
            got = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(flat, row * size + got, value)
        rows = row[np.concatenate([[True], row[1:] != row[:-1]])]
        done = np.zeros(len(out), dtype=bool)
        done[rows[out[rows].max(axis=1) < ((j + 1) << 24)]] = True
        live = ~done[row]
        if not live.all():
            e, row = e[live], row[live]
            moved = [(a[live], b[live]) for a, b in moved]
            order = None if order is None else order[live]


def bands(sign: np.ndarray) -> np.ndarray:
    """BANDS bucket keys a row."""
    code = np.zeros((len(sign), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        code = code * np.uint64(0xD6E8FEB86659FD93) + sign[:, j::ROWS].astype(np.uint64) + np.uint64(1)
    return X.mix(code + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(a, 50_000) for a in range(0, b.num_rows, 50_000))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), f1, f2 (fingerprint of the set), bands, sign (low bytes of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in X.pieces(_few_rows(batches)):
            s, first = shingles(X.words(data, at))
            n = np.diff(first)
            sign = signatures(s, first)
            total = np.zeros((2, len(s) + 1), dtype=np.uint64)
            np.cumsum(X.mix(s + np.uint64(1)), out=total[0, 1:])
            np.cumsum(X.mix(s * np.uint64(3) + np.uint64(7)), out=total[1, 1:])
            f = total[:, first[1:]] - total[:, first[:-1]]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(X.signed(bands(sign)).reshape(-1)))
            low = pa.array([r.tobytes() for r in sign.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(X.signed(f[0])), pa.array(X.signed(f[1])), keys, low], names=["doc_id", "n", "f1", "f2", "bands", "sign"])

    return _narrow(docs).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sign binary")


def sets(docs: DataFrame) -> DataFrame:
    """doc_id and its whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in X.pieces(_few_rows(batches)):
            s, first = shingles(X.words(data, at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(X.signed(s)))], names=["doc_id", "shingles"])

    return _narrow(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components of two signatures' low bytes that agree."""
    return (a == b).sum(axis=1)


@F.pandas_udf(T.IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), SIZE) for s in (a, b))
    return pd.Series(_agree(x, y).astype(np.int32))


def verified(docs: DataFrame, pairs: DataFrame, percent: int = 75) -> DataFrame:
    """Of ``pairs`` (a, b), those whose whole sets have that similarity. Sets are made anew, only of documents in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    full = sets(docs.join(ids, "doc_id", "left_semi"))
    left, right = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("common") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _earlier(members: DataFrame) -> DataFrame:
    """``members`` with the keys of the bands before theirs, in place of all: what they tell is where a pair met before."""
    return members.withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands")


def _matrix(t: pa.Table) -> np.ndarray:
    """Keys of earlier bands: rows by BANDS, 0 beyond a row's own."""
    lists = t["earlier"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), BANDS), dtype=np.int64)
    out[np.arange(BANDS) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """A bucket of many members is cut in blocks, and each pair of blocks (i, j) is a task's work of its own."""
    cut = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cut.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other", "members")


def _candidates(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """Rows k, and d, of pairs (k, k + d) in one block that may be links and first meet here. ``t``: whole blocks, n ascending in each."""
    group = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
    band, n, comp, block = (t[c].to_numpy() for c in ("band", "n", "component", "block"))
    sign = np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint8).reshape(len(n), SIZE)
    earlier = _matrix(t)
    at, d = np.arange(max(len(n) - 1, 0)), 1
    while len(at):
        at = at[at + d < len(n)]
        at = at[(group[:, at] == group[:, at + d]).all(axis=0)]
        # Beyond this ratio of sizes the sets cannot be similar enough.
        at = at[100 * n[at] >= percent * n[at + d]]
        own = at[(comp[at] != comp[at + d]) & ((group[1][at] == group[2][at]) | (block[at] != block[at + d]))]
        own = own[_agree(sign[own], sign[own + d]) >= AGREE]
        # By whole keys: signatures' low bytes may agree in a band whose bucket the two do not share.
        met = (earlier[own] == earlier[own + d]) & (np.arange(BANDS) < band[own][:, None])
        yield own[~met.any(axis=1)], d
        d += 1


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole blocks."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        same = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in ("key", "i", "j")])
        cut = int(np.argmax(same))
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut).combine_chunks()
    if held is not None:
        yield held


def _sorted(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "id")


def _in_question(blocks: DataFrame, percent: int) -> DataFrame:
    """Of all members of blocks, those of a pair that may be a link (key, i, j, id): only they need their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_block(batches):
            wanted = np.zeros(len(t), dtype=bool)
            for own, d in _candidates(t, percent):
                wanted[own] = wanted[own + d] = True
            yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[wanted]) for c in ("key", "i", "j", "id")], names=["key", "i", "j", "id"])

    return _sorted(blocks.select("key", "i", "j", "band", "n", "id", "component", "block", "sign", "earlier")).mapInArrow(run, "key long, i long, j long, id long")


def _links_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a block: key, i, j, band, n, id, component, block, sign, earlier, shingles.

    Pairs are never rows: each is held against whole sets where it first meets, if sizes and signatures allow the
    similarity and nothing found so far has joined its components. What comes out is at most a forest of each task's components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for t in _by_block(batches):
            id_, comp = t["id"].to_numpy(), t["component"].to_numpy()
            lists = t["shingles"].combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            out: list[tuple[int, int]] = []
            for own, d in _candidates(t, percent):
                for k in own.tolist():
                    x, y = root(int(comp[k])), root(int(comp[k + d]))
                    if x != y:
                        u, v = values[at[k] : at[k + 1]], values[at[k + d] : at[k + d + 1]]
                        common = len(u) + len(v) - len(np.union1d(u, v))
                        if 100 * common >= percent * (len(u) + len(v) - common):
                            parent[max(x, y)] = min(x, y)
                            out.append((int(id_[k]), int(id_[k + d])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _sorted(blocks.select("key", "i", "j", "band", "n", "id", "component", "block", "sign", "earlier", "shingles")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts of white space have no shingles and link with nothing. Rows that share a
    doc_id count as one document, linked through either text. Rows without doc_id link with nothing and are
    kept. Other columns are ignored; an empty table gives no rows.
    """
    before = tables()
    every = written(describe(docs), "minhash")
    known = every.filter("n > 0 and doc_id is not null")
    classes = written(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("times"), F.first("bands").alias("bands"), F.first("sign").alias("sign")), "classes")
    n_rows, n_classes = classes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    rows = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("p"), F.max("id").alias("q")).filter("members > 1")
    members = written(spread_join(rows, buckets, ["key"], "members", "id", n_classes * BANDS), "buckets")
    signs = classes.select("id", "n", "sign")
    # Each class against the pivots of its buckets, the best of which is verified.
    pairs = members.select("id", F.explode(F.array("p", "q")).alias("pivot")).filter("id <> pivot").distinct()
    pairs = pairs.join(signs, "id").join(signs.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("sign").alias("other")), "pivot")
    pairs = pairs.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).withColumn("agree", _agreement("sign", "other")).filter(F.col("agree") >= AGREE)
    best = pairs.groupBy("id").agg(F.max(F.struct("agree", (-F.col("pivot")).alias("pivot"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.pivot")).alias("b"))
    links = written(verified(docs, written(best, "pairs"), percent), "links")
    # Rows that share a doc_id link their classes.
    of_doc = known.select("doc_id", "f1", "f2", "n").distinct()
    several = of_doc.join(of_doc.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1"), "doc_id").join(classes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"])
    twice = several.join(several.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b")
    links = written(links.unionByName(twice), "links")
    first = written(components(links), "components")
    labelled = members.select("key", "band", "id", "members").join(first, F.col("id") == F.col("node"), "left").select("key", "band", "id", "members", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k")).filter("low < high").select("key", "k")
    open_ = written(spread_join(labelled, mixed, ["key"], "k", "id", n_classes * BANDS).drop("k"), "open")
    blocks = _blocks(_earlier(open_.join(classes.select("id", "n", "sign", "bands"), "id")))
    asked = written(_in_question(blocks, percent), "asked")
    whole = sets(docs.join(asked.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")).select(F.col("doc_id").alias("id"), "shingles")
    links = links.unionByName(written(_links_in_blocks(blocks.join(asked, ["key", "i", "j", "id"], "left_semi").join(whole, "id"), percent), "links"))
    final = written(components(links), "components")
    of_class = classes.select("f1", "f2", "n", "id", "times").join(final, F.col("id") == F.col("node"), "left").select("f1", "f2", "n", "times", F.coalesce("component", "id").alias("component_id"))
    of_class = written(of_class, "classes")
    forget(before, every, of_class)
    placed = spread_join(known.select("doc_id", "n", "f1", "f2"), of_class, ["f1", "f2", "n"], "times", None, n_rows).select("doc_id", "n", "component_id")
    rest = every.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = placed.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
