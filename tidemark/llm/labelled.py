"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stash

#: Labelled documents of each class that a classifier is fitted on, at most.
PER_CLASS = 4_096


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def known_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """One row (doc_id, label 0 or 1) per labelled document that is not held out; of several labels the largest holds."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int = PER_CLASS) -> DataFrame:
    """Rows (doc_id, label 0 or 1, text) of at most ``per_class`` documents of either class, none of them held out; written to the shared folder.

    Documents come in the order of a hash of their ids. Null or other labels do not count; of several labels of a document the largest
    holds, of several texts the smallest. Only the sampled ids are broadcast.
    """
    known = known_labels(labels, label, modulus, remainder)
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return stash(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
