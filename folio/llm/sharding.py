"""Shards along a Hilbert curve over several metadata dimensions, cut into runs of equal row counts.

Each dimension is quantised at its own quantiles over all rows, so that cells are evenly used; strings are
compared whole. Rows are sorted by curve index, with doc_id, size and
checksum behind it, ranked across partitions, and cut: row r of n goes to shard r * shards / n. Rows close on the
curve are close in every dimension, so each shard's minimum and maximum prune filters on any of them.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import forget, tables, written

BITS = 6
ACCURACY = 2000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of ``cells`` (n by dimensions, 0 to 2**bits - 1) on the curve, by Skilling's transpose form (2004)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[dims - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value(df: DataFrame, name: str) -> Column:
    """A string as it is, any other column as a number in the same order. Null: below all."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.col(name), F.lit(""))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def _string_edges(df: DataFrame, name: str, cells: int) -> list[str]:
    """Exact quantiles of a string column over rows: the strings in which a multiple of 1 / ``cells`` of all rows is reached, each once."""
    kinds = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    kinds = written(kinds.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "strings")
    parts = kinds.groupBy("part").agg(F.sum("n").alias("own"))  # a row a partition
    parts = parts.select("part", (F.sum("own").over(W.Window.orderBy("part")) - F.col("own")).alias("first"), F.sum("own").over(W.Window.partitionBy()).alias("all"))
    within = F.sum("n").over(W.Window.partitionBy("part").orderBy("value"))
    reached = kinds.withColumn("within", within).join(F.broadcast(parts), "part").withColumn("stop", F.col("first") + F.col("within"))
    reached = reached.filter(f"least(stop * {cells} div all, {cells - 1}) > (stop - n) * {cells} div all")
    return sorted(r.value for r in reached.select("value").collect())  # bounded: one a cell


def hilbert_shards(df: DataFrame, dimensions: list[str], tie: list[str], shards: int = 24, bits: int = BITS) -> DataFrame:
    """``df`` with hilbert, shard and slot; columns of these names that ``df`` has are replaced, all others stay whatever
    their names. Counts of shards differ by one at most.

    Null values of a dimension have its lowest cell; strings count whole, however long; equal rows are ranked in any order,
    once; an empty table stays empty. Keep ``df`` narrow: it is written twice, as it is and in order, so that it is computed
    once and ranks are fixed for all later reads.
    """
    names = [f"dim{i}" for i in range(len(dimensions))]
    before = tables()
    held = written(df, "rows")
    packed = held.select(F.struct(*[F.col(f"`{c}`") for c in held.columns]).alias("row"), *[_value(held, d).alias(n) for n, d in zip(names, dimensions, strict=True)])
    steps = (1 << bits) - 1
    share = [(k + 1) / (steps + 1) for k in range(steps)]
    strings = {n for n in names if isinstance(packed.schema[n].dataType, T.StringType)}
    numbers = [F.percentile_approx(F.when(F.col(n) > float("-inf"), F.col(n)), share, ACCURACY).alias(n) for n in names if n not in strings]
    found = packed.agg(*numbers).first().asDict() if numbers else {}
    # Bounded: 2**bits a dimension.
    edges = [_string_edges(packed, n, steps + 1) if n in strings else np.unique(np.array(found[n] if found[n] is not None else [], dtype=float)) for n in names]

    @F.pandas_udf("long")
    def index(cols: pd.DataFrame) -> pd.Series:
        own = [[bisect_right(e, x) for x in cols[n]] if n in strings else np.searchsorted(e, cols[n].to_numpy(), side="right") for n, e in zip(names, edges, strict=True)]
        cells = np.stack(own, axis=1)
        return pd.Series(hilbert_index(cells, bits))

    placed = packed.withColumn("hilbert", index(F.struct(*names))).drop(*names)
    order = [F.col("hilbert"), *[F.col(f"row.`{c}`") for c in tie]]
    sorted_ = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "hilbert")
    forget(before, sorted_)
    part, own = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("own"))  # a row a partition
    every = W.Window.orderBy("part")
    counts = counts.select("part", (F.sum("own").over(every) - F.col("own")).alias("before"), F.sum("own").over(W.Window.partitionBy()).alias("all"))
    ranked = sorted_.withColumn("part", part).join(F.broadcast(counts), "part").withColumn("rank", (F.col("before") + own).cast("long"))
    # Shard s begins at the first rank r with r * shards >= s * n.
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div all").cast("int"))
    slot = F.col("rank") - F.expr(f"(shard * all + {shards - 1}) div {shards}")
    kept = [F.col(f"row.`{c}`").alias(c) for c in held.columns if c not in ("hilbert", "shard", "slot")]
    return ranked.select(*kept, "hilbert", "shard", slot.alias("slot"))
