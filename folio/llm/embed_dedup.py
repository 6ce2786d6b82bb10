"""Links between embeddings by cross-polytope hashing (Andoni et al. 2015) and exact cosines.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest of the 2d signed axes. ``width`` hashes in a row make a bucket of a table.
A vector is stored in one bucket a table and also asks the next nearest ones (multiprobe). Two vectors meet
where one is stored and the other is stored or asks; each meeting's cosine is computed in double precision.

A pair that meets more than once counts at its first meeting alone, which both vectors' codes tell, so counts
of links add up without a list of pairs. Only (bucket, vector) pairs are shuffled to find buckets where vectors meet; the
vectors themselves go to those alone. Equal vectors are one class that counts as often as it occurs. Buckets
over BLOCK vectors are cut into blocks, and each pair of blocks is work of its own.

The number of tables follows from the chance that a pair at the wanted cosine meets in one, which is measured on
random pairs of the same dimension, so that RECALL of such pairs meet at any dimension and width.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .common import forget, lean, spread_join, tables, tidy, written
from .components import components

#: Share of pairs at the very limit that meet; of closer pairs more do.
RECALL = 0.995
PROBES = 3
#: Buckets for each vector: about one meeting by chance a bucket, whatever the number of vectors.
SPARSE = 1
#: Hashes in a row at most: with these, buckets outnumber any collection.
WIDEST = 6
BLOCK = 400
SMALL = 48


def rotations(dim: int, n: int, seed: int = 11) -> np.ndarray:
    """Signs of n rotations, three rounds each, of vectors padded to a power of two."""
    size = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64([seed, size])).choice(np.array([-1.0, 1.0], np.float32), (n, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x by one rotation: Hadamard times signs, thrice, up to a factor."""
    y = x
    for s in signs:
        y = y * s
        step = 1
        while step < y.shape[1]:
            pair = y.reshape(len(y), -1, 2, step)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(y), -1)
            step *= 2
        y = y * np.float32(len(s) ** -0.5)
    return y


def codes(x: np.ndarray, width: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Buckets of unit vectors: rows by tables by probes; the first is where a vector is stored."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size), dtype=np.float32)
    padded[:, : x.shape[1]] = x
    signs, out = rotations(x.shape[1], width * tables), np.empty((len(x), tables, probes), dtype=np.int64)
    near, rows = min(probes, size), np.arange(len(x))
    for t in range(tables):
        best, gaps = [], []
        for k in range(width):
            y = rotate(padded, signs[t * width + k])
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            best.append(2 * top + (value < 0))
            gaps.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        # Probes change one hash each, to its next nearest axes, the cheapest first.
        code = sum(b[:, 0] * (2 * size) ** k for k, b in enumerate(best))
        cost = np.concatenate([g[:, 1:] for g in gaps], axis=1)
        other = np.concatenate([code[:, None] + (b[:, 1:] - b[:, :1]) * (2 * size) ** k for k, b in enumerate(best)], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = code
        out[:, t, 1:] = code[:, None]
        out[:, t, 1 : 1 + order.shape[1]] = other[rows[:, None], order]
    return out


def pairs_at(dim: int, cosine: float, n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at this cosine."""
    r = np.random.Generator(np.random.PCG64([seed, dim]))
    x, z = r.normal(size=(n, dim)), r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + (1 - cosine * cosine) ** 0.5 * z


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs by tables: whether one is stored where the other is stored or asks (codes: pairs by tables by probes)."""
    return (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)


@functools.cache
def tables_for(dim: int, width: int, cosine: float, recall: float = RECALL, pairs: int = 400, tried: int = 24) -> int:
    """Tables with which ``recall`` of pairs at the cosine meet. Measured on ``pairs`` pairs in ``tried`` tables, less two standard errors."""
    x, y = pairs_at(dim, cosine, pairs)
    met = meet(codes(x, width, tried), codes(y, width, tried))
    p = met.mean()
    # Some pairs meet less than others: the spread between pairs counts, not their mean alone.
    p = max(p - 2 * met.mean(axis=1).std() / pairs**0.5 - 2 * (p * (1 - p) / met.size) ** 0.5, 0.5 / met.size)
    return max(2, int(np.ceil(np.log(1 - recall) / np.log1p(-min(p, 1 - 1e-9)))))


def _first_meeting(own: np.ndarray, other: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether pairs (their codes: pairs by tables by probes) meet in ``table`` at bucket ``code`` for the first time."""
    a, b = own[:, :, 0], other[:, :, 0]
    at_b = (own == b[:, :, None]).any(axis=2)
    at_a = (other == a[:, :, None]).any(axis=2)
    meets = at_a | at_b
    first = meets.argmax(axis=1)
    rows = np.arange(len(own))
    far = np.iinfo(np.int64).max
    where = np.minimum(np.where(at_a[rows, first], a[rows, first], far), np.where(at_b[rows, first], b[rows, first], far))
    return (first == table) & (where == code)


def _vectors(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All numbers in a row, begin and size of each vector, and which vectors are whole, finite and not zero."""
    column = batch.column(name)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = pc.list_flatten(column)
    bad = pc.is_null(flat).to_numpy(zero_copy_only=False)
    x = pc.fill_null(flat, 0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(x))])
    some = np.concatenate([[0], np.cumsum(x != 0)])
    ok = (bad[begin[1:]] == bad[begin[:-1]]) & (some[begin[1:]] > some[begin[:-1]])
    return x, begin[:-1], size, ok


def describe(vectors: DataFrame, kind: type = np.float64) -> DataFrame:
    """vec_id, class (128 bits of a hash of its numbers; null: links with nothing), dim, vec (its numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, begin, size, ok = _vectors(batch, "embedding")
            raw = [(x[b : b + n] + 0.0).astype(kind).tobytes() if k else None for b, n, k in zip(begin.tolist(), size.tolist(), ok.tolist(), strict=True)]
            name = [hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(name, pa.binary()), pa.array(np.where(ok, size, 0), pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "class", "dim", "vec"])

    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return narrow.mapInArrow(run, "vec_id long, class binary, dim int, vec binary")


def _hashed(classes: DataFrame, width: int, tables: int, kind: type) -> DataFrame:
    """``classes`` with codes: tables by PROBES buckets in a row, null where a probe repeats one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    x = np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(part.num_rows, dim).astype(np.float64)
                    c = codes(_unit(x), width, tables)
                    again = np.zeros(c.shape, dtype=bool)
                    for p in range(1, PROBES):
                        again[:, :, p] = (c[:, :, p : p + 1] == c[:, :, :p]).any(axis=2)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * tables * PROBES, pa.int32()), pa.array(c.reshape(-1), mask=again.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "codes"])

    return classes.select("class", "id", "times", "dim", "vec").mapInArrow(run, "class binary, id long, times long, dim int, vec binary, codes array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(hashed: DataFrame, cosine: float, tables: int, kind: type) -> DataFrame:
    """By bucket and class: class, id, n (links counted there, as often as the other occurs), low (the smallest id of its links' component in the bucket)."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = t["dim"].to_numpy()
        for dim in np.unique(dims):
            part = t if (dims == dim).all() else t.filter(pa.array(dims == dim))
            group = np.stack([part[c].to_numpy() for c in ("key", "i", "j", "table", "code")])
            new = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
            name, (id_, times, block) = part["class"].combine_chunks(), (part[c].to_numpy() for c in ("id", "times", "block"))
            own = pc.fill_null(pc.list_flatten(part["codes"].combine_chunks()), -1).to_numpy(zero_copy_only=False).reshape(len(name), tables, PROBES)
            x = _unit(np.frombuffer(b"".join(part["vec"].to_pylist()), kind).reshape(len(name), dim).astype(np.float64))
            stored = own[np.arange(len(name)), group[3], 0] == group[4]
            begin = np.append(np.flatnonzero(new), len(name))
            size = np.diff(begin)
            a, b = [], []
            # Small groups side by side: each row against the one d rows on.
            small = np.repeat(size <= SMALL, size)
            left = np.repeat(begin[1:], size) - np.arange(len(name)) - 1
            at, d = np.flatnonzero(small & (left >= 1)), 1
            while len(at):
                near = at[np.einsum("ij,ij->i", x[at], x[at + d]) >= cosine]
                a.append(near), b.append(near + d)
                d += 1
                at = at[left[at] >= d]
            for s, e in zip(begin[:-1][size > SMALL].tolist(), begin[1:][size > SMALL].tolist(), strict=True):
                for r in range(s, e, 500):
                    p, q = np.nonzero(x[r : min(r + 500, e)] @ x[s:e].T >= cosine)
                    p, q = p + r, q + s
                    a.append(p[p < q]), b.append(q[p < q])
            a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
            ok = (stored[a] | stored[b]) & ((group[1][a] == group[2][a]) | (block[a] != block[b]))
            a, b = a[ok], b[ok]
            first = np.zeros(len(a), bool)
            for s in range(0, len(a), 100_000):
                i, j = a[s : s + 100_000], b[s : s + 100_000]
                first[s : s + 100_000] = _first_meeting(own[i], own[j], group[3][i], group[4][i])
            a, b = a[first], b[first]
            n = np.bincount(a, times[b], len(name)) + np.bincount(b, times[a], len(name))
            low = id_.copy()
            while True:
                least = np.minimum(low[a], low[b])
                before = low.copy()
                np.minimum.at(low, a, least), np.minimum.at(low, b, least)
                if (before == low).all():
                    break
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(some)), pa.array(id_[some]), pa.array(n[some].astype(np.int64)), pa.array(low[some])], names=["class", "id", "n", "low"])

    names = ("key", "i", "j", "table", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        lean()
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            same = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in names])
            cut = int(np.argmax(same))
            if cut:
                yield from found(t.slice(0, cut))
            held = t.slice(cut).combine_chunks()
        if held is not None:
            yield from found(held)
        tidy()

    each = hashed.select("class", "dim", F.posexplode("codes").alias("pos", "code")).filter("code is not null").withColumn("table", F.expr(f"cast(pos div {PROBES} as int)"))
    each = each.select("class", F.xxhash64("dim", "table", "code").alias("key"), "table", "code", (F.col("pos") % PROBES == 0).alias("stored"))
    meet = each.groupBy("key").agg(F.count("*").alias("members"), F.max("stored").alias("any")).filter("members > 1 and any").select("key", "members")
    live = written(each.select("key", "class", "table", "code").join(meet, "key"), "meetings")
    cut = live.join(hashed, "class").withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "id", "times", "dim", "table", "code", "codes", "vec", "block")
    return cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "table", "code", "class").mapInArrow(run, "class binary, id long, n long, low long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, width: int | None = None) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold nulls or numbers that aren't finite link with nothing, as do
    vectors of different dimensions with each other. Repeated rows are vectors of their own and link. Rows
    without vec_id link with nothing and are kept. Other columns are ignored; an empty table gives no rows.
    """
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    before = tables()
    every = written(describe(vectors.filter("vec_id is not null"), kind), "vectors")
    classes = written(every.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    n, n_rows, dim = classes.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    if width is None:
        width = min(WIDEST, max(1, int(np.ceil(np.log(SPARSE * max(n, 2)) / np.log(2 * max(dim, 2))))))
    n_tables = tables_for(dim, width, cosine)
    links = written(_links(written(_hashed(classes, width, n_tables, kind), "hashed"), cosine, n_tables, kind), "links")
    counts = links.groupBy("class").agg(F.sum("n").alias("n"))
    parts = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    of_class = classes.select("class", "id", "times").join(counts, "class", "left").join(parts, F.col("id") == F.col("node"), "left")
    of_class = written(of_class.select("class", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "classes")
    forget(before, every, of_class)
    out = spread_join(every.filter("class is not null").select("vec_id", "class"), of_class, ["class"], "times", None, n_rows)
    alone = every.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    odd = vectors.filter("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(odd).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
