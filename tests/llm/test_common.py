"""Joins of hot keys, written tables and what is left of them."""

from pathlib import Path

from pyspark.sql import functions as F

from folio.llm import common


def test_a_hot_key_is_dealt_over_tasks_and_joins_all_the_same(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("top")).filter("k <> 9")
    for by in ("id", None):
        got = common.spread_join(rows, classes, ["k"], "times", by, 3000)
        assert sorted(got.columns) == ["id", "k", "times", "top"]
        assert sorted(map(tuple, got.select("k", "id", "times", "top").collect())) == sorted(map(tuple, rows.join(classes, "k").select("k", "id", "times", "top").collect()))
    assert common.spread_join(rows.filter("false"), classes, ["k"], "times", "id", 0).count() == 0


def test_written_tables_are_deleted_once_not_needed(spark):
    before = common.tables()
    kept, gone = common.written(spark.range(5), "kept"), common.written(spark.range(6), "gone")
    paths = {Path(p.removeprefix("file:")) for p in common.tables() - before}
    assert len(paths) == 2 and all(p.exists() for p in paths)
    common.forget(before, kept)
    assert kept.count() == 5 and sum(p.exists() for p in paths) == 1
    common.remove(kept)
    common.remove(gone)  # again: nothing happens
    assert not any(p.exists() for p in paths) and common.tables() == before


def test_the_session_s_own_batch_size_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.modest(spark)
    assert spark.conf.get(key) == str(common.BATCH_BYTES)
    spark.conf.set(key, "1234567")
    common.modest(spark)
    assert spark.conf.get(key) == "1234567"
    spark.conf.unset(key)


def test_tables_go_to_the_folder_that_the_cluster_names(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
