"""Tables, written intermediate results and bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import BATCH_BYTES, modest

assert BATCH_BYTES  # for those who look here for it
_written: list[tuple[SparkSession, str, DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder in the warehouse, which
    driver and executors share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later jobs survive lost executors and compute nothing twice."""
    spark = df.sparkSession
    modest(spark)
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, back))
    return back


def spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], times: str, by: str | None, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``classes``, which hold each key once and in ``times`` how many of the n rows have it.

    A key of more than n / 500 rows is dealt over several tasks by a hash of the rows' column ``by``, by place if there is
    none that tells them apart. Such keys are 500 at most, so their table is broadcast at any size.
    """
    limit = max(64, n // 500)
    hot = classes.filter(F.col(times) > limit).select(*keys, F.ceil(F.col(times) / limit).alias("_copies"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_copy", F.pmod(F.xxhash64(by if by else F.monotonically_increasing_id()), F.coalesce("_copies", F.lit(1)))).drop("_copies")
    copies = classes.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(times) / limit), F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "_copy"], how).drop("_copy")


def remove(df: DataFrame) -> None:
    """Deletes what ``written`` made as ``df``, once nothing reads it any more."""
    for item in [w for w in _written if w[2] is df]:
        _delete(item[0], item[1])
        _written.remove(item)


def tables() -> set[str]:
    """Where all that ``written`` has left stands now: for ``forget``."""
    return {path for _, path, _ in _written}


def forget(before: set[str], *keep: DataFrame) -> None:
    """Deletes what ``written`` made since ``before`` but for ``keep``, what a result still reads."""
    for _, path, df in list(_written):
        if path not in before and not any(df is k for k in keep):
            remove(df)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_written() -> None:
    """Deletes what ``written`` has left. Called at the end of the process; call it earlier only once results are stored."""
    while _written:
        try:
            _delete(*_written.pop()[:2])
        except Exception:  # the session has ended
            return


_lean = False


def lean() -> None:
    """In a Python worker, once: large blocks come from the system and go back to it as soon as they are free."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # not this C library
            c = ctypes.CDLL(None)
            c.mallopt(-3, 4 << 20), c.mallopt(-1, 16 << 20)  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def tidy() -> None:
    """At the end of a Python worker's task: gives freed memory back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


atexit.register(remove_written)
