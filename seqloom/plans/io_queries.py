"""Round trips: tables written in each exchange form and read back, and matrix checks of the structure operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, graph, population, sampling
from ..scratch import Scratch
from ..sources import readers, writers
from .adapters import buyers, table
from .kmer_queries import joined
from .registry import query
from .relation_queries import SEGMENTS, SKETCH_SQL, segment_presence, word_sketches


def folder(spark: SparkSession) -> str:
    return f"{Scratch(spark).root}/files"


@query("SELECT (p_partkey % 3)::BIGINT AS sample_id, (row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1)::BIGINT AS read_no, p_name AS seq FROM part")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as the reads of three FASTQ files."""
    path = folder(spark)
    record = F.concat(F.lit("@r"), "p_partkey", F.lit("\n"), "p_name", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("p_name")))
    parts = table(spark, sf_dir, "part").withColumn("f", F.col("p_partkey") % 3).repartition(3, "f").sortWithinPartitions("f", "p_partkey")
    parts.select("f", record.alias("value")).write.partitionBy("f").text(path)
    files = spark.read.text(path).select("f", F.col("_metadata.file_path").alias("path")).distinct().orderBy("f").collect()
    return readers.fastq(spark, [r.path for r in files])


@query("SELECT (p_partkey % 2)::BIGINT AS sample_id, (row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) - 1)::BIGINT AS read_no, p_name || p_type AS seq FROM part")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types as the two lines of each record of two FASTA files."""
    path = folder(spark)
    parts = table(spark, sf_dir, "part").withColumn("f", F.col("p_partkey") % 2).repartition(2, "f").sortWithinPartitions("f", "p_partkey")
    parts.select("f", F.concat(F.lit(">r"), "p_partkey", F.lit("\n"), "p_name", F.lit("\n"), "p_type").alias("value")).write.partitionBy("f").text(path)
    files = spark.read.text(path).select("f", F.col("_metadata.file_path").alias("path")).distinct().orderBy("f").collect()
    return readers.fasta(spark, [r.path for r in files])


@query("SELECT c_mktsegment AS rname, (c_custkey % 60)::INT AS mapq, c_name AS seq FROM customer")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as alignments, with a header line."""
    path = folder(spark)
    line = F.concat_ws("\t", F.lit("q"), F.lit("0"), "c_mktsegment", F.lit("1"), F.col("c_custkey") % 60, F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), "c_name", F.lit("*"))
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string")
    table(spark, sf_dir, "customer").select(line.alias("value")).union(head).write.text(path)
    return readers.sam(spark, path)


@query("SELECT n_name AS rname, s_name AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def translated_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as three-column alignments."""
    path = folder(spark)
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    both.select(F.concat_ws("\t", F.lit("q"), "n_name", "s_name").alias("value")).union(spark.createDataFrame([("#qid\trid\tqseq",)], "value string")).write.text(path)
    return readers.translated(spark, path).select("rname", "seq")


@query("SELECT s_name AS kmer, (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS idx FROM supplier")
def kmer_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as an indexed list."""
    path = folder(spark)
    table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_name").coalesce(1).write.text(path)
    return readers.kmer_lines(spark, path)


@query("SELECT n_name AS key, n_nationkey / 100.0::DOUBLE AS pval FROM nation")
def results_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as CSV with a checked header."""
    path = folder(spark)
    writers.results_csv(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), (F.col("n_nationkey") / 100).alias("pval")), path)
    return readers.checked_csv(spark, [path], "key string, pval double")


@query(f"WITH {SEGMENTS} SELECT kmer::VARCHAR AS kmer, array_to_string(list_sort(list(sample_id)), ',') AS samples FROM seg GROUP BY kmer")
def presence_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence rows as JSON lines."""
    path = folder(spark)
    writers.presence_json(segment_presence(spark, sf_dir).withColumn("kmer", F.col("kmer").cast("string")), path)
    return readers.presence_json(spark, path).select("kmer", joined("samples").alias("samples"))


@query(f"WITH {SEGMENTS} SELECT sample_id::VARCHAR AS gene, array_to_string(list_sort(list(kmer)), ',') AS kmers FROM seg GROUP BY sample_id")
def gene_sets_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each nation as sorted gene sets."""
    path = folder(spark)
    sets = segment_presence(spark, sf_dir).select(F.explode("samples").alias("s"), "kmer").groupBy(F.col("s").cast("string").alias("gene")).agg(F.collect_set("kmer").alias("kmers"))
    writers.gene_sets_json(sets, path)
    return readers.gene_sets_json(spark, path).select("gene", joined("kmers").alias("kmers"))


@query("SELECT (s_suppkey % 3)::INT AS comp, s_name AS kmer, s_acctbal::DOUBLE AS loading FROM supplier")
def components_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of three components as JSON lines."""
    path = folder(spark)
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("comp"), F.col("s_name").alias("kmer"), F.col("s_acctbal").cast("double").alias("loading"))
    writers.components_json(rows, path)
    return readers.components_json(spark, path)


@query("SELECT p_partkey AS kmer, p_size AS n FROM part")
def sorted_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in range-sorted files."""
    path = folder(spark)
    writers.sorted_parquet(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kmer"), F.col("p_size").alias("n")), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey AS kmer, p_size::BIGINT AS mnz FROM part")
def minimizer_folders_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in folders of their minimizers (here: sizes)."""
    path = folder(spark)
    writers.by_minimizer(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kmer"), F.col("p_size").cast("bigint").alias("mnz")), path, 8)
    return spark.read.parquet(path).select("kmer", "mnz")


@query("SELECT DISTINCT l_partkey AS kmer, o_custkey AS sample_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def range_part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by sorted key ranges."""
    return sampling.range_parts(buyers(spark, sf_dir), 8)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, 1099511627776 + l_partkey AS b FROM lineitem) SELECT v AS vertex, count(*)::BIGINT AS degree FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of suppliers and parts; edges are given in both directions and repeatedly."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + F.lit(1 << 40)).alias("b"))
    return graph.degrees(e.union(e.select("b", "a")))


@query(f"""WITH {SKETCH_SQL}, len AS (SELECT kmer, count(*) AS n FROM sketch GROUP BY kmer), c AS (SELECT x.kmer AS a, y.kmer AS b, count(*)::BIGINT AS shared FROM sketch x JOIN sketch y ON x.hash = y.hash AND x.kmer < y.kmer GROUP BY x.kmer, y.kmer)
SELECT a, b, shared FROM c JOIN len p ON p.kmer = a JOIN len q ON q.kmer = b WHERE shared >= least(37, p.n, q.n)""")
def minhash_candidates_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share 37 of 50 hashes, or all of the smaller sketch."""
    return clustering.candidates(word_sketches(spark, sf_dir), relative=True)


GRAM_SQL = f"""{SEGMENTS}, ids AS (SELECT DISTINCT sample_id AS i FROM seg), g0 AS (SELECT x.sample_id AS i, y.sample_id AS j, count(*)::DOUBLE AS v FROM seg x JOIN seg y ON x.kmer = y.kmer GROUP BY x.sample_id, y.sample_id),
g AS (SELECT a.i, b.i AS j, coalesce(v, 0) AS v FROM ids a CROSS JOIN ids b LEFT JOIN g0 ON g0.i = a.i AND g0.j = b.i)"""


def nation_gram(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, list[int], DataFrame]:
    has = Scratch(spark).cut(segment_presence(spark, sf_dir))
    samples = [r[0] for r in has.select(F.explode("samples").alias("s")).distinct().orderBy("s").collect()]
    return population.gram_matrix(population.gram(has), samples), samples, has


def matrix_rows(spark: SparkSession, samples: list[int], **matrices: np.ndarray) -> DataFrame:
    rows = [(a, b, *(float(m[i, j]) for m in matrices.values())) for i, a in enumerate(samples) for j, b in enumerate(samples) if i < j]
    made = spark.createDataFrame(pd.DataFrame(rows, columns=["i", "j", *matrices]), "i bigint, j bigint, " + ", ".join(f"{m} double" for m in matrices))
    return made.select("i", "j", *[F.round(m, 6).alias(m) for m in matrices])


@query(f"""WITH {GRAM_SQL}, m AS (SELECT i, avg(v) AS a FROM g GROUP BY i), w AS (SELECT avg(v) AS a FROM g), c AS (SELECT g.i, g.j, v - p.a - q.a + w.a AS v FROM g JOIN m p ON p.i = g.i JOIN m q ON q.i = g.j, w),
s AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM c x JOIN c y ON x.j = y.i GROUP BY x.i, y.j), t AS (SELECT sum(v) AS t FROM c WHERE i = j)
SELECT 1 AS power, 1.0::DOUBLE AS moment UNION ALL SELECT 2, round((SELECT sum(v * v) FROM c) / (t * t), 8) FROM t
UNION ALL SELECT 3, round((SELECT sum(s.v * c.v) FROM s JOIN c ON c.i = s.i AND c.j = s.j) / (t * t * t), 8) FROM t UNION ALL SELECT 4, round((SELECT sum(v * v) FROM s) / (t * t * t * t), 8) FROM t""")
def pca_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the first four powers of all explained-variance ratios; in SQL they are traces of powers of the centred Gram matrix."""
    g, samples, _ = nation_gram(spark, sf_dir)
    share = population.decompose(g, len(samples))[2]
    return spark.createDataFrame([(p, round(float((share**p).sum()), 8)) for p in range(1, 5)], "power int, moment double")


@query(f"""WITH {SEGMENTS}, ids AS (SELECT DISTINCT sample_id FROM seg), n AS (SELECT count(*)::DOUBLE AS n FROM ids), k AS (SELECT kmer, count(*) / (SELECT n FROM n) AS mean FROM seg GROUP BY kmer)
SELECT k.kmer, ids.sample_id, round((seg.kmer IS NOT NULL)::INT - mean, 6) AS value FROM k CROSS JOIN ids LEFT JOIN seg ON seg.kmer = k.kmer AND seg.sample_id = ids.sample_id""")
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings times scores over all components: the centred presence of each part in each nation."""
    _, samples, has = nation_gram(spark, sf_dir)
    loadings, scores, _ = population.population_structure(has, samples, n=len(samples))
    long = scores.melt("sample_id", var_name="pc", value_name="score")
    long["comp"] = long["pc"].str[2:].astype(int)
    known = spark.createDataFrame(long[["sample_id", "comp", "score"]], "sample_id bigint, comp int, score double")
    value = F.round(F.sum(F.col("loading") * F.col("score")), 6).alias("value")
    return loadings.join(F.broadcast(known), "comp").groupBy("kmer", "sample_id").agg(value)


DISTANCES = "SELECT x.i, x.j, round(1 - x.v / sqrt(p.v * q.v), 6) AS cosine, round(sqrt(p.v + q.v - 2 * x.v), 6) AS euclidean FROM g x JOIN g p ON p.i = x.i AND p.j = x.i JOIN g q ON q.i = x.j AND q.j = x.j WHERE x.i < x.j"


@query(f"WITH {GRAM_SQL} {DISTANCES}")
def sample_dissimilarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and euclidean dissimilarity of nations by their parts."""
    g, samples, _ = nation_gram(spark, sf_dir)
    return matrix_rows(spark, samples, cosine=population.cosine_dissimilarity(g), euclidean=population.euclidean(g))


@query(f"WITH {GRAM_SQL}, d AS ({DISTANCES}) SELECT i, j, euclidean AS distance FROM d")
def mds_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the scaled points in as many dimensions as it takes: those that were put in."""
    g, samples, _ = nation_gram(spark, sf_dir)
    x = population.mds(population.euclidean(g), n=len(samples) - 1)
    return matrix_rows(spark, samples, distance=np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)))


@query(f"WITH {GRAM_SQL}, d AS (SELECT x.i, x.j, p.v + q.v - 2 * x.v AS d FROM g x JOIN g p ON p.i = x.i AND p.j = x.i JOIN g q ON q.i = x.j AND q.j = x.j), n AS (SELECT sqrt(sum(d)) AS n FROM d) SELECT i, j, round(sqrt(d) / n, 6) AS distance FROM d, n WHERE i < j")
def pca_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the scores over all components, as a matrix of norm 1."""
    g, samples, _ = nation_gram(spark, sf_dir)
    u, values, _ = population.decompose(g, len(samples))
    return matrix_rows(spark, samples, distance=population.pca_distances(u * np.sqrt(values)))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS score FROM supplier")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with mean 0 and deviation 1."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("b")).toPandas()
    rows["score"] = population.standard_scores(rows[["b"]].to_numpy())[:, 0]
    return spark.createDataFrame(rows[["s_suppkey", "score"]], "s_suppkey bigint, score double").select("s_suppkey", F.round("score", 6).alias("score"))


