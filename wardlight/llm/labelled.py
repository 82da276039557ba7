"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Most labelled documents that a model is fitted on: those with the least hashes of their ids.
SAMPLE = 12000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; without an id, -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``label`` and ``text`` of at most ``size`` labelled documents under ``learn`` (a condition on doc_id), read and kept once.

    The sample of the labels has a fixed bound, so it is broadcast.  An id with several labels counts as 1 if one is; of several rows
    of an id the text of least hash is taken, so repeated rows don't widen the sample.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
