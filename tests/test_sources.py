"""Readers, writers and streams round trips."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.operators import presence as P
from seqloom.sources import readers, writers
from seqloom.streaming import incremental


def test_fastq(spark, tmp_path):
    a, b = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    a.write_text("".join(f"@r{i}\nACGT{'A' * i}\n+\n{'@' * (4 + i)}\n" for i in range(5)))
    b.write_bytes(gzip.compress(b"@x\r\nGGGG\r\n+\r\n!!!!\r\n"))
    rows = sorted(map(tuple, readers.fastq(spark, [str(a), str(b)]).collect()))
    assert rows == [(0, i, "ACGT" + "A" * i) for i in range(5)] + [(1, 0, "GGGG")]
    parts = [readers.fastq(spark, [str(a), str(b)], p, 2) for p in range(2)]
    assert sorted(tuple(r) for p in parts for r in p.collect()) == rows


def test_alignments(spark, tmp_path):
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\tVN:1\nq\t0\tg1\t1\t42\t4M\t*\t0\t0\tACGT\tIIII\n")
    assert [tuple(r) for r in readers.sam(spark, str(sam)).collect()] == [("g1", 42, "ACGT")]
    tsv = tmp_path / "x.tsv"
    tsv.write_text("#c\nq\tg\tACGT\n")
    assert readers.translated(spark, str(tsv)).first().rname == "g"


def test_kmer_lists(spark, tmp_path):
    p = tmp_path / "k.txt"
    p.write_text("ACGT\nTTTT\n")
    assert [tuple(r) for r in readers.kmer_lines(spark, str(p), 4).orderBy("idx").collect()] == [("ACGT", 0), ("TTTT", 1)]
    p.write_text("ACGT\nACGT\n")
    with pytest.raises(ValueError):
        readers.kmer_lines(spark, str(p))


def test_csv_headers(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("key,pval\nx,0.5\n")
    b.write_text("key,other\ny,0.1\n")
    assert readers.checked_csv(spark, [str(a)], "key string, pval double").count() == 1
    with pytest.raises(ValueError):
        readers.checked_csv(spark, [str(a), str(b)], "key string, pval double")
    cov = readers.covariates(spark, str(a))
    assert cov.first().sample_id == 0
    with pytest.raises(TypeError):
        readers.covariates(spark, "x.h5")


def test_line_counts_and_variance(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("key\nx\ny\n")
    b.write_text("key\n")
    assert sorted(map(tuple, readers.line_counts(spark, [str(a), str(b)]).collect())) == [(str(a), 2), (str(b), 0)]
    b.write_text("")
    with pytest.raises(ValueError):
        readers.line_counts(spark, [str(a), str(b)])
    writers.explained_variance_csv([0.75, 0.25], str(tmp_path / "v"), spark)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "v"), header=True, schema="comp int, explained double").collect()] == [(0, 0.75), (1, 0.25)]
    has = spark.createDataFrame([("A", [1, 2])], "kmer string, samples array<bigint>")
    writers.sorted_parquet(has, str(tmp_path / "p"))
    assert [tuple(r) for r in readers.presence_parquet(spark, str(tmp_path / "p")).collect()] == [("A", [1, 2])]
    writers.sorted_parquet(has.selectExpr("kmer", "size(samples) n"), str(tmp_path / "n"))
    assert [tuple(r) for r in readers.counts_parquet(spark, str(tmp_path / "n")).collect()] == [("A", 2)]


def test_json_round_trips(spark, tmp_path):
    has = spark.createDataFrame([("A", [1, 2]), ("C", [])], "kmer string, samples array<bigint>")
    writers.presence_json(has, str(tmp_path / "h"))
    assert sorted(map(tuple, readers.presence_json(spark, str(tmp_path / "h")).collect())) == [("A", [1, 2]), ("C", [])]
    comps = spark.createDataFrame([(0, "A", 0.5), (1, "A", 1.0), (1, "C", -1.0)], "comp int, kmer string, loading double")
    writers.components_json(comps, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.components_json(spark, str(next((tmp_path / "c").glob("part*")))).collect())) == sorted(map(tuple, comps.collect()))
    genes = spark.createDataFrame([("g", [3, 1])], "gene string, kmers array<bigint>")
    writers.gene_sets_json(genes, str(tmp_path / "g"))
    assert readers.gene_sets_json(spark, str(tmp_path / "g")).first().kmers == [1, 3]
    (tmp_path / "m.json").write_text(json.dumps({"g": ["k1", "k2"], "h": []}))
    assert readers.group_lists_json(spark, str(tmp_path / "m.json")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 5, 1), ("C", 9, 2)], "kmer string, mnz bigint, n int")
    writers.by_minimizer(df, str(tmp_path / "b"), 4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    writers.sorted_parquet(df, str(tmp_path / "s"))
    writers.results_csv(df, str(tmp_path / "r"))
    tested = spark.createDataFrame([("g", True), ("h", False)], "gene string, significant boolean")
    writers.enrichment_json(tested, tested, str(tmp_path / "e"))
    assert json.loads(next((tmp_path / "e").glob("part*")).read_text()) == {"sig": ["g"], "found": ["g", "h"]}
    writers.clusters_json(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "kmer string, component string"), str(tmp_path / "k"))
    lines = [x for f in sorted((tmp_path / "k").glob("part*")) for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [["a", "b"], ["c"]]


def test_streaming_counts(spark, tmp_path):
    reads = [(0, 0, "AAAAC"), (1, 0, "AAAA"), (1, 1, "AAAA")]
    table = spark.createDataFrame(reads, "sample_id bigint, read_no int, seq string")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    table.coalesce(1).write.parquet(src)
    stream = incremental.streaming_counts(spark.readStream.schema(table.schema).parquet(src), 3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("kmer_counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.kmer: r.n for r in P.kmer_counts(incremental.kmer_stream(table, 3)).collect()}
    assert {r.kmer: r.n for r in spark.table("kmer_counts").collect()} == want
    incremental.append_presence(table, out, 3)
    incremental.append_presence(table.where(F.col("sample_id") == 1), out, 3)
    assert spark.read.parquet(out).count() == incremental.kmer_stream(table, 3).distinct().count()
