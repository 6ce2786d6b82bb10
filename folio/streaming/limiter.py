"""Streams: rates of engines as their outcomes arrive, and books that are taken up as files appear."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.translate import next_rate


def rates(outcomes: DataFrame, base: float) -> DataFrame:
    """A stream of (engine, seq, ok) to engine, rate, n whenever an engine's outcomes arrive; outcomes of a batch count by seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, good, n = state.get if state.exists else (base, 0, 0)
        for ok in pd.concat(list(frames)).sort_values("seq")["ok"]:
            n += 1
            rate, good = next_rate(rate, good, ok, base)
        state.update((rate, good, n))
        yield pd.DataFrame([(key[0], rate, n)], columns=["engine", "rate", "n"])

    return outcomes.groupBy("engine").applyInPandasWithState(step, "engine string, rate double, n long", "rate double, good int, n long", "update", GroupStateTimeout.NoTimeout)


def books(spark: SparkSession, path: str, schema: str, checkpoint: str, run: Callable[[DataFrame, int], None], slots: int = 2):
    """Starts a query that hands over ``slots`` new files at a time; a file is handed over again only if its batch did not end."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", slots).parquet(path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
