"""Bounded samples of labelled rows, the only thing a classifier here is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.session import ship


def crc_bucket(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; null ids count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % n


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int) -> DataFrame:
    """Rows (doc_id, label, text) of at most ``per_class`` documents of each label, 0 and 1.

    Only ids for which ``learn`` holds are looked at, and among them those with the least
    hash, so that the choice depends on nothing but the ids. Labels other than 0 and 1 are
    left out; of several labels of an id the largest holds.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    present = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.lit(29), F.col("doc_id"))
    chosen = present.where("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(present.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    chosen = common.materialize(chosen, "chosen")  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(F.col("text").cast("string")).alias("text"))
    return common.materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
