"""Incremental presence and counts over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import canonical_kmers, with_canonical_kmers
from ..schema import K


def kmer_stream(reads: DataFrame, k: int = K) -> DataFrame:
    """sample_id and kmer of each window; stateless, so it works for streams and tables."""
    return with_canonical_kmers(reads, k)


def streaming_counts(reads: DataFrame, k: int = K) -> DataFrame:
    """kmer and n, the samples that have had it so far. State holds each (kmer, sample) pair once, by key."""
    return kmer_stream(reads, k).dropDuplicates(["kmer", "sample_id"]).groupBy("kmer").agg(F.count("*").alias("n"))


def windowed_counts(reads: DataFrame, event_time: str, window: str = "1 hour", watermark: str = "2 hours", k: int = K) -> DataFrame:
    """Counts of k-mer windows per event-time window; rows later than the watermark are dropped with its state."""
    words = reads.withWatermark(event_time, watermark).select(event_time, F.explode(F.array_distinct(canonical_kmers("seq", k))).alias("kmer"))
    return words.groupBy(F.window(event_time, window), "kmer").agg(F.count("*").alias("n"))


def append_presence(batch: DataFrame, path: str, k: int = K) -> None:
    """A foreachBatch sink: the distinct (kmer, sample) pairs of a batch that the table at `path` lacks are appended."""
    spark = batch.sparkSession
    new = kmer_stream(batch, k).distinct()
    try:
        known = spark.read.parquet(path)
    except Exception as fault:  # no table yet
        if "PATH_NOT_FOUND" not in str(fault) and "UNABLE_TO_INFER" not in str(fault):
            raise
        known = None
    if known is not None:
        new = new.join(known, ["kmer", "sample_id"], "left_anti")
    new.write.mode("append").parquet(path)
