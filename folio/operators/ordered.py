"""Ranks and ordered folds over groups of any size.

Rows are dealt in order over all tasks by ranges of (group, order), so that a large group is cut and many small
ones share a task. What a task must know of those before it is a few numbers, composed on the driver.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


#: Bytes of an Arrow batch between the JVM and Python, in place of Spark's default. Both sides hold several at a time outside of any heap.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")


def modest(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, unless they have been set already. It changes no result."""
    if spark.conf.get(_BATCH) in _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder (spark.checkpoint.dir; where that is unset, the warehouse)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))
    return df.checkpoint()


_packed: list[tuple[SparkSession, str]] = []


def packed(df: DataFrame) -> DataFrame:
    """``stored`` for what takes much room and is read as a table: compressed, a column at a time, in no order and partitions of its own. Deleted at the end of the process."""
    stored(df.limit(0))  # sets the folder where none is set
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/packed-{uuid.uuid4().hex}"
    _packed.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _unpack() -> None:
    while _packed:
        spark, path = _packed.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            return


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in the order of ``keys``, cut over tasks by ranges of them; later jobs see the same cuts."""
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def numbered(df: DataFrame, group: str, order: str, name: str = "row_no") -> DataFrame:
    """``df`` with the place of each row in its group, from 0 by ``order``, and ``name``_n: rows of the group."""
    own = dealt(df, group, order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = own.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.Window.partitionBy("_g").orderBy("_p")
    parts = parts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.Window.partitionBy("_g")))
    joined = own.join(parts, own[group].eqNullSafe(parts["_g"]) & (own["_part"] == parts["_p"]))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name), F.col("_all").alias(f"{name}_n"))


def folded(df: DataFrame, group: str, order: list[str], schema: str, begin: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame | None]], end: Callable[[object, object], pd.DataFrame] | None = None) -> DataFrame:
    """An ordered fold of each group, a stretch of its rows at a time: ``step`` takes the state and the stretch and gives
    the state and rows. A group's state machine runs in one task, but holds a batch of rows at most.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, open_ = None, None, False
        for frame in frames:
            if not len(frame):
                continue
            codes, _ = pd.factorize(frame[group], use_na_sentinel=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = frame[group].iloc[a]
                same = open_ and (own == key or (pd.isna(own) and pd.isna(key)))
                if not same:
                    if open_ and end:
                        yield end(key, state)
                    key, state, open_ = own, begin(), True
                state, rows = step(state, frame.iloc[a:b])
                if rows is not None:
                    yield rows
        if open_ and end:
            yield end(key, state)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, work: Callable[[tuple, list], Iterator[tuple] | list[tuple]]) -> DataFrame:
    """``work`` (key, rows) of each group, its rows as named tuples in order: the rows that it gives. One group is held at a time,
    and many small ones share a batch. ``keys`` come first in ``df``; nulls are None.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    n = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None) if frame.isna().any(axis=None) else frame
            for row in frame.itertuples(index=False, name="Row"):
                if held and row[:n] != key:
                    out += work(key, held)
                    held = []
                key = row[:n]
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            yield pd.DataFrame(list(work(key, held)), columns=names)

    return df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# Greedy batches: each takes rows in order until it holds ``most`` of them or would pass ``limit`` characters.


def starts(sizes: np.ndarray, most: int, limit: int) -> np.ndarray:
    """If a batch starts at row i: where the next one does."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(len(sizes))
    by_chars = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return np.minimum(np.minimum(i + most, np.maximum(i + 1, by_chars)), len(sizes))


def _numbers(sizes: np.ndarray, most: int, limit: int, taken: int = 0, first: int = 0) -> np.ndarray:
    """Batch of each row, where the first ``taken`` belong to batch ``first`` - 1, begun before them."""
    after = starts(sizes, most, limit).tolist()
    marks = np.zeros(len(sizes), dtype=np.int64)
    at = taken
    while at < len(sizes):
        marks[at] = 1
        at = after[at]
    return np.cumsum(marks) + first - 1


def _exits(sizes: np.ndarray, most: int, limit: int) -> list[tuple[int, int, int]]:
    """For 0 to ``most`` rows taken by a batch begun before: batches started here, and rows and characters of the last, left open."""
    after, n = starts(sizes, most, limit).tolist(), len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    known: dict[int, tuple[int, int]] = {}
    out = []
    for taken in range(min(most, n) + 1):
        path, at = [], taken
        while at < n and at not in known:
            path.append(at)
            at = after[at]
        count, last = known.get(at, (0, n))
        for at in reversed(path):
            last = at if not count else last
            count += 1
            known[at] = (count, last)
        out.append((count, n - last, int(total[n] - total[last])) if count else (0, 0, 0))
    return out


def batch_numbers(df: DataFrame, group: str, order: str, size: str, most: int, limit: int, name: str = "batch_no") -> DataFrame:
    """``df`` with the batch of each row in its group, from 0. A batch is closed when it is full or would hold too many
    characters; a row too large for any stands alone.

    Each task tells how its first group goes on for any number of its rows that an earlier task's open batch takes
    (``most`` + 1 cases); the driver follows these from task to task; then each task numbers its rows.
    """
    own = dealt(df, group, order)

    def stretches(frames: Iterator[pd.DataFrame]) -> list[tuple[object, np.ndarray]]:
        """Sizes by stretches of equal group: a number a row."""
        out: list[tuple[object, list[np.ndarray]]] = []
        for frame in frames:
            if not len(frame):
                continue
            codes, _ = pd.factorize(frame[group], use_na_sentinel=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(frame)]
            values = frame[size].fillna(0).to_numpy(dtype=np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = frame[group].iloc[a]
                key = None if pd.isna(key) else key
                if out and out[-1][0] == key:
                    out[-1][1].append(values[a:b])
                else:
                    out.append((key, [values[a:b]]))
        return [(k, np.concatenate(v)) for k, v in out]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = stretches(frames)
        if found:
            (first, sizes), (last, final) = found[0], found[-1]
            ends = _exits(final, most, limit)[0]
            yield pd.DataFrame([(TaskContext.get().partitionId(), repr(first), repr(last), len(found) == 1, np.cumsum(sizes[:most]).tolist(), len(sizes), int(sizes.sum()), [x for e in _exits(sizes, most, limit) for x in e], list(ends))], columns=["part", "first", "last", "single", "heads", "n", "chars", "exits", "ends"])

    narrow = own.select(group, size)
    told = sorted(narrow.mapInPandas(look, "part int, first string, last string, single boolean, heads array<long>, n long, chars long, exits array<long>, ends array<long>").collect(), key=lambda r: r.part)
    entries: dict[int, tuple[int, int]] = {}  # a task: rows taken by the batch before, number of the next one
    key, batch, held, chars = None, -1, 0, 0
    for r in told:
        taken = 0
        if r.first == key:
            room = [k + 1 for k, c in enumerate(r.heads) if held + k + 1 <= most and chars + c <= limit]
            taken = room[-1] if room else 0
        else:
            batch, held, chars = -1, 0, 0
        entries[r.part] = (taken, batch + 1)
        if not r.single:
            key, (count, held, chars) = r.last, r.ends
            batch = count - 1
            continue
        count, rows, size_ = r.exits[3 * taken : 3 * taken + 3]
        key, batch = r.first, batch + count
        held, chars = (rows, size_) if count else (held + taken, chars + r.chars)

    schema = T.StructType([*own.schema.fields, T.StructField(name, T.IntegerType())])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, first = entries.get(TaskContext.get().partitionId(), (0, 0))
        held = list(frames)
        numbers = [_numbers(sizes, most, limit, *((taken, first) if k == 0 else ())) for k, (_, sizes) in enumerate(stretches(iter(held)))]
        at, whole = 0, np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        for frame in held:
            yield frame.assign(**{name: whole[at : at + len(frame)].astype(np.int32)})
            at += len(frame)

    return own.mapInPandas(number, schema)
