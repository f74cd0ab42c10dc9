"""Counting, presence and merging of keys over samples.

The operators take a long relation (sample_id, key) and work for k-mers and for any other key.
Partial aggregation happens before every shuffle, and arrays are only made for keys that are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import in_part, with_canonical_kmers
from ..schema import K
from . import buckets


def union(frames: tuple[DataFrame, ...]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b), frames)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deals a scan of few splits over the cluster before its rows are multiplied."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, *cols) if df.rdd.getNumPartitions() < wanted else df


def sample_kmers(reads: DataFrame, k: int = K, min_count: int = 2, max_count: int = 255, packed: bool = False) -> DataFrame:
    """sample_id, kmer, n of canonical k-mers seen min_count times or more in a sample; n is capped at max_count."""
    words = with_canonical_kmers(reads, k, packed)
    return words.groupBy("sample_id", "kmer").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).withColumn("n", F.least("n", F.lit(max_count).cast("bigint")))


def kmer_counts(kmers: DataFrame, key: str = "kmer", part: int | None = None, parts: int = 1) -> DataFrame:
    """key and n, the number of samples that have it; optionally for one hash part of the keys."""
    own = kmers.where(in_part(key, part, parts)) if part is not None else kmers
    return own.select(key, "sample_id").distinct().groupBy(key).agg(F.count("*").alias("n"))


def filter_counts(counts: DataFrame, min_n: int = 0) -> DataFrame:
    """The keys of counts that reach min_n."""
    return counts.where(F.col("n") >= min_n).drop("n")


def presence(kmers: DataFrame, whitelist: DataFrame | None = None, key: str = "kmer") -> DataFrame:
    """key and the sorted distinct samples that have it, for whitelisted keys."""
    own = kmers.select(key, "sample_id")
    if whitelist is not None:
        own = own.join(whitelist.select(key), key, "left_semi")
    return own.groupBy(key).agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))


def explode_presence(has: DataFrame, key: str = "kmer") -> DataFrame:
    return has.select(key, F.explode("samples").alias("sample_id"))


def merge_counts(*frames: DataFrame, key: str = "kmer") -> DataFrame:
    """Sums the counts of each key."""
    return union(frames).groupBy(key).agg(F.sum("n").alias("n"))


def merge_presence(*frames: DataFrame, key: str = "kmer") -> DataFrame:
    """Concatenates and sorts the samples of each key; repeats stay."""
    return union(frames).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("samples"))).alias("samples"))


def merge_profiles(*frames: DataFrame) -> DataFrame:
    """Sums long-form profiles by k-mer, position and base."""
    return union(frames).groupBy("kmer", "pos", "base").agg(F.sum("n").alias("n"))


def merge_packed_profiles(*frames: DataFrame) -> DataFrame:
    """Sums profiles whose counts travel in packets; profiles.unpacked() gives the long form."""
    return buckets.merge_packets(union(frames))


def merge_gene_sets(*frames: DataFrame) -> DataFrame:
    """Union of the k-mer indices of each gene."""
    return union(frames).select("gene", F.explode("kmers").alias("idx")).groupBy("gene").agg(F.array_sort(F.collect_set("idx")).alias("kmers"))


#: Payload merges by name, for pipelines that choose one by a parameter; `register_merge` adds more.
MERGES = {"count": merge_counts, "has": merge_presence, "profile": merge_profiles, "packed profile": merge_packed_profiles, "genes": merge_gene_sets}


def register_merge(name: str, merge) -> None:
    """Adds an aggregate over any number of frames under a name of its own."""
    if name in MERGES:
        raise ValueError(f"merge {name!r} exists")
    MERGES[name] = merge


def merge(kind: str, *frames: DataFrame, **options) -> DataFrame:
    if kind not in MERGES:
        raise ValueError(f"unknown merge {kind!r}; known: {', '.join(sorted(MERGES))}")
    return MERGES[kind](*frames, **options)


def bonferroni(results: DataFrame, alpha: float = 0.05, pvalue: Column | str = "pval") -> DataFrame:
    """Adds `significant`: p <= alpha / number of rows.."""
    rows = results.count()
    p = F.col(pvalue) if isinstance(pvalue, str) else pvalue
    return results.withColumn("significant", F.coalesce(p <= alpha / rows if rows else F.lit(False), F.lit(False)))


def presence_matrix(has: DataFrame, n_samples: int, key: str = "kmer") -> DataFrame:
    """key and a 0/1 array of n_samples, dense only for the rows asked for; samples without a key keep their column."""
    bad = F.exists("samples", lambda s: (s < 0) | (s >= n_samples))
    # Zeros fill the gaps between sorted samples, so a row costs its length once.
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    ordered = has.select(key, F.array_sort(F.array_distinct(F.array_compact("samples"))).alias("s"), bad.alias("bad"))
    before = lambda k: F.coalesce(F.get("s", k - 1), F.lit(-1))
    row = F.concat(F.flatten(F.transform("s", lambda x, k: F.concat(zeros(x - before(k) - 1), F.array(F.lit(1))))), zeros(F.lit(n_samples - 1) - before(F.size("s"))))
    return ordered.select(key, F.when(F.col("bad"), F.raise_error(F.lit("sample beyond n_samples")).cast("array<int>")).otherwise(row).alias("row"))
