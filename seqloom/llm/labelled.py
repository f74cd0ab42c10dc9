"""Bounded samples of labelled documents for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hash(c: Column) -> Column:
    """60 bits of the md5 of a value's text, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")


def held_out(c: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality", keep: Column | None = None) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most `rows` labelled ids, those with the smallest id hashes.

    Rows without id or label are left out; an id with several labels takes their rounded mean.
    The ids go to the executors as a broadcast table of at most `rows` rows.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    if keep is not None:
        known = known.where(keep)
    ids = known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y")).orderBy(key_hash(F.col("doc_id")), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
