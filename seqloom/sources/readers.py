"""Readers of sequence and result files. Each names its schema, so no pass infers one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import in_part


def sample_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """sample_id (place in the list, from 0) and path."""
    return spark.createDataFrame(list(enumerate(paths)), "sample_id bigint, path string")


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, line (from 0) and value of text files, split as the engine likes.

    Lines are numbered within each block of a file, after the counts of the file's blocks before it, so
    no task holds more than a block (a compressed file is one block).
    """
    raw = spark.read.text(list(paths)).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("rows"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select("path", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    inner = F.row_number().over(W.partitionBy("path", "block").orderBy("m")) - 1
    return raw.join(ahead, ["path", "block"]).select("path", (F.col("ahead") + inner).alias("line"), "value")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the engine's file metadata writes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString())


def fastq(spark: SparkSession, paths: Sequence[str], part: int | None = None, parts: int = 1) -> DataFrame:
    """sample_id, read_no, seq of FASTQ files (plain or gzip); the sample id is the file's place in the list."""
    samples = sample_list(spark, paths)
    if part is not None:
        samples = samples.where(in_part("path", part, parts))
    chosen = [(r.sample_id, r.path, qualified(spark, r.path)) for r in samples.collect()]
    if not chosen:
        return spark.createDataFrame([], "sample_id bigint, read_no bigint, seq string")
    names = spark.createDataFrame([(i, q) for i, _, q in chosen], "sample_id bigint, path string")
    lines = numbered_lines(spark, [p for _, p, _ in chosen]).where("line % 4 = 1")
    return lines.join(names, "path").select("sample_id", F.floor(F.col("line") / 4).cast("bigint").alias("read_no"), F.regexp_replace("value", "\r$", "").alias("seq"))


def fasta(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """sample_id, read_no, seq of FASTA files; the lines of a record are put together in order, and a record without lines is left out."""
    names = spark.createDataFrame([(i, qualified(spark, p)) for i, p in enumerate(paths)], "sample_id bigint, path string")
    lines = numbered_lines(spark, paths).withColumn("head", F.col("value").startswith(">"))
    # A record is known by the line of its header: the last one up to each line.
    order = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("read_no", (F.sum(F.col("head").cast("long")).over(order) - 1)).where("not head and read_no >= 0")
    part = F.struct("line", F.trim(F.regexp_replace("value", "\r$", "")).alias("seq"))
    whole = placed.groupBy("path", "read_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["seq"]), "").alias("seq"))
    return whole.join(F.broadcast(names), "path").select("sample_id", "read_no", "seq").where("seq <> ''")


def line_counts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and rows (header left out) of result files; an empty file is an error."""
    names = spark.createDataFrame([(p, qualified(spark, p)) for p in paths], "name string, path string")
    counted = spark.read.text(list(paths)).groupBy(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path")).agg((F.count("*") - 1).alias("rows"))
    out = names.join(counted, "path", "left")
    empty = out.where("coalesce(rows, -1) < 0").head(1)
    if empty:
        raise ValueError(f"{empty[0]['name']} is empty")
    return out.select(F.col("name").alias("path"), "rows")


def counts_parquet(spark: SparkSession, path: str) -> DataFrame:
    """kmer and n of a written table of counts."""
    return spark.read.parquet(path).select("kmer", F.col("n").cast("bigint").alias("n"))


def presence_parquet(spark: SparkSession, path: str) -> DataFrame:
    """kmer and samples of a written presence table."""
    return spark.read.parquet(path).select("kmer", F.col("samples").cast("array<bigint>").alias("samples"))


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """rname, mapq and seq of SAM alignments; header lines start with @."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    return lines.select(F.get(parts, F.lit(2)).alias("rname"), F.get(parts, F.lit(4)).cast("int").alias("mapq"), F.get(parts, F.lit(9)).alias("seq"))


def translated(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """rname and seq of three-column tab-separated alignments (qid, rid, qseq); # starts a comment; other widths fail."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="qid string, rid string, qseq string", mode="FAILFAST")
    return raw.select(F.col("rid").alias("rname"), F.lit(None).cast("int").alias("mapq"), F.col("qseq").alias("seq"))


def kmer_lines(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """kmer and idx (line number from 0) of a text list; a repeated word, or one of another length than k, is an error."""
    lines = numbered_lines(spark, [path]).select(F.col("line").alias("idx"), F.regexp_replace("value", "\r$", "").alias("kmer")).where("kmer <> ''")
    again = lines.groupBy("kmer").count().where("count > 1").head(1)
    if again:
        raise ValueError(f"repeated k-mer {again[0]['kmer']}")
    if k is not None and lines.where(F.length("kmer") != k).head(1):
        raise ValueError(f"k-mer not of length {k}")
    return lines.select("kmer", F.col("idx").cast("bigint").alias("idx"))


def checked_csv(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """CSV files with one header; a file whose header differs from the schema's names is an error."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    for p in paths:
        first = spark.read.text(p).head(1)
        if not first:
            raise ValueError(f"{p} is empty")
        if first[0]["value"].split(",") != names:
            raise ValueError(f"{p} has another header")
    return spark.read.csv(list(paths), header=True, schema=schema, mode="FAILFAST")


def covariates(spark: SparkSession, path: str, sample_order: bool = True) -> DataFrame:
    """Covariates of a .csv, .tsv or .parquet file, with sample_id as the row's place when the file has none."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith((".csv", ".tsv")):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.endswith(".tsv") else ",")
    else:
        raise TypeError(f"unknown kind of table: {path}; write others (HDF5 frames, say) as .parquet first, with pandas.read_hdf(...).to_parquet(...)")
    if "sample_id" in df.columns or not sample_order:
        return df
    numbered = df.withColumn("_m", F.monotonically_increasing_id())
    return numbered.withColumn("sample_id", (F.row_number().over(W.orderBy("_m")) - 1).cast("bigint")).drop("_m")


def presence_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="kmer string, samples array<bigint>", mode="FAILFAST")


def gene_sets_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.json(path, schema="Gene string, Kmers array<bigint>", mode="FAILFAST")
    return raw.select(F.col("Gene").alias("gene"), F.array_sort(F.array_distinct("Kmers")).alias("kmers"))


def components_json(spark: SparkSession, path: str) -> DataFrame:
    """comp, kmer, loading of one JSON object per component, in file order."""
    lines = numbered_lines(spark, [path]).select(F.col("line").cast("int").alias("comp"), "value").where("value <> ''")
    return lines.select("comp", F.explode(F.from_json("value", "map<string,double>")).alias("kmer", "loading"))


def group_lists_json(spark: SparkSession, path: str, key: str = "gene", group: str = "ko") -> DataFrame:
    """key and group, one row for each member of the lists of one JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, "all"))
    return raw.select(key, F.explode("all").alias(group))
