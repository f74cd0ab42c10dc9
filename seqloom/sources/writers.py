"""Writers. Parquet is the native form; the text forms are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_parquet(df: DataFrame, path: str, key: str = "kmer", mode: str = "error") -> None:
    """Range-sorted files, so that key ranges can be pruned by their statistics and the encodings stay small."""
    df.orderBy(key).write.mode(mode).parquet(path)


def by_minimizer(df: DataFrame, path: str, buckets: int = 256, mode: str = "error") -> None:
    """Rows of one minimizer in one of `buckets` folders: bounded in number, whatever the minimizer length."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64("mnz"), F.lit(buckets)).cast("int"))
    out.repartition(buckets, "bucket").sortWithinPartitions("mnz", "kmer").write.mode(mode).partitionBy("bucket").parquet(path)


def presence_json(has: DataFrame, path: str, mode: str = "error") -> None:
    has.select("kmer", "samples").write.mode(mode).json(path)


def gene_sets_json(genes: DataFrame, path: str, mode: str = "error") -> None:
    genes.orderBy("gene").select(F.col("gene").alias("Gene"), F.array_sort("kmers").alias("Kmers")).write.mode(mode).json(path)


def enrichment_json(tested: DataFrame, found: DataFrame, path: str, mode: str = "error") -> None:
    """One object with the sorted significant and found genes."""
    sig = tested.where("significant").agg(F.array_sort(F.collect_list("gene")).alias("sig"))
    all_ = found.agg(F.array_sort(F.collect_list("gene")).alias("found"))
    sig.join(F.broadcast(all_), F.lit(True)).coalesce(1).write.mode(mode).json(path)


def results_csv(results: DataFrame, path: str, mode: str = "error") -> None:
    results.write.mode(mode).csv(path, header=True)


def components_json(components: DataFrame, path: str, mode: str = "error") -> None:
    """One object of loadings per component, in order."""
    rows = components.groupBy("comp").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kmer", "loading"))))).alias("value"))
    rows.orderBy("comp").select("value").coalesce(1).write.mode(mode).text(path)


def explained_variance_csv(share, path: str, spark, mode: str = "error") -> None:
    """comp and explained-variance ratio of each component, in order."""
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(share)], "comp int, explained double")
    rows.orderBy("comp").coalesce(1).write.mode(mode).csv(path, header=True)


def clusters_json(clusters: DataFrame, path: str, key: str = "kmer", mode: str = "error") -> None:
    """One sorted list of keys per component, largest first."""
    lists = clusters.groupBy("component").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    lists.orderBy(F.desc(F.size("keys")), "component").select(F.to_json("keys").alias("value")).write.mode(mode).text(path)
