"""Labelled training documents, a bounded number of them, without moving the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_documents(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled documents outside the held-out fold.

    They are the first by a hash of the id, so a larger corpus gives another sample of the same size; the ids
    are broadcast, which `most` bounds. A document with several labels has the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), rows["id"] == chosen["doc_id"]).select("id", "text", "label")
