"""A training corpus from raw documents: toxic ones go, one of each group of near duplicates stays, documents that
hold a benchmark item go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return
the columns of ``documents``; the last returns a row a piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, minhash, packing, toxicity
from folio.llm.common import forget, remove, table, tables, written

TOXIC_AT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows of ``docs``, scores below TOXIC_AT.

    Each row is judged by its own text: repeated rows and rows without doc_id alike, null and empty texts stay. Columns
    of any name are carried along; an empty table stays empty.
    """
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    scores = toxicity.tag(docs, crf, carry=docs.columns)
    return scores.filter(F.col(scores.columns[-1]) < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id.

    Rows that share a doc_id or have none are documents of their own; of equal ones any stays. Null and empty texts link with nothing
    and stay. Columns of any name are carried along; an empty table stays empty.
    """
    several = docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 or doc_id is null").select("doc_id")
    if several.isEmpty():
        gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # So few rows are odd that they alone are written with a number of their own, below all ids.
    least = min(docs.agg(F.min("doc_id")).first()[0] or 0, 0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    odd = docs.select(row).join(F.broadcast(several.select(F.struct("doc_id").alias("s"))), F.col("row.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    odd = written(odd.withColumn("key", F.lit(least - 1) - F.monotonically_increasing_id()), "odd-rows")
    plain = docs.join(several.filter("doc_id is not null"), "doc_id", "left_anti").filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), row)
    rows = plain.unionByName(odd.select("key", "row"))
    found = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    ids = rows.select("key", F.col("row.doc_id").alias("own"))
    best = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "key")).alias("best"))
    kept = best.select(F.col("best.key").alias("key"))
    return rows.join(kept, "key", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget: each row by its own text, those without doc_id too. Null and
    empty texts stay; columns of any name are carried along; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are an end id alone; repeated rows and rows without doc_id are packed each; other columns, ``start``
    among them, are not read; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: No SQL trains the model or encodes tokens; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, before = docs, tables()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(before, docs)
        remove(last)
    return STAGES[-1][1](spark, docs, sf_dir)
