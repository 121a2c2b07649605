"""Bounded, repeatable samples of labelled documents for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, label: str, learnable: Column, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, label`` of all learnable ids; null ids and labels are left out, of an id labelled twice the larger counts."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).dropna().filter(learnable)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, limit: int,
                    doc_id: str = "doc_id", text: str = "text", each: bool = False) -> DataFrame:
    """``doc_id, text, label`` of at most ``limit`` labelled documents, those of the smallest hashed ids.

    Rows with a null id or label are left out; of an id labelled twice the larger label counts. The ids are chosen
    before any text is read, so the documents are scanned once, against a list of bounded size, and no text is
    shuffled. An id that several documents share comes with each of them: callers reduce to one row per id. With
    ``each`` the limit holds for positive labels and for the others on their own, so a rare label is not crowded out.
    """
    known = labelled(labels, label, learnable, doc_id)

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    positive = F.col("label") > 0
    chosen = smallest(known.filter(positive)).unionByName(smallest(known.filter(~positive))) if each else smallest(known)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
