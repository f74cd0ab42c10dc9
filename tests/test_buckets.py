"""Counts and profiles by packets of words, against loops over strings."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import buckets, profiles
from seqloom.operators import presence as P

READS = "sample_id bigint, read_no int, seq string"


def back(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


@pytest.fixture(scope="module")
def dna():
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(6)]
    rows = [(s, n, (pool[rng.integers(6)] + pool[rng.integers(6)])[rng.integers(30) :][:100]) for s in range(20) for n in range(2)]
    # An id with several rows, which tell the same reads apart by nothing; N, small letters, short, empty, null, and a word that is its own complement.
    return [*rows, (3, 0, pool[0]), (3, 0, back(pool[1])), (4, 0, pool[0][:30] + "N" + pool[0][31:]), (5, 0, pool[2].lower()), (6, 0, "ACGT"), (7, 0, ""), (8, 0, None), (9, 0, "TT" + "ACGT" * 5 + "GG")]


def words(rows):
    found = defaultdict(set)
    for s, _, seq in rows:
        for i in range(len(seq or "") - 19):
            w = seq[i : i + 20].upper()
            if "N" not in w:
                found[min(w, back(w))].add(s)
    return {w: len(s) for w, s in found.items()}


def counted(rows, listed):
    out = Counter()
    for _, _, seq in rows:
        for s in (seq, back(seq)) if seq else ():
            for i in range(len(s) - 19):
                if s[i : i + 20].upper() in listed:
                    out.update((s[i : i + 20].upper(), j + 100 - i, b) for j, b in enumerate(s) if b in "ACGT" and 0 <= j + 100 - i < 220)
    return out


def test_whole_kmer_counts(spark, dna, monkeypatch):
    reads = spark.createDataFrame(sorted(dna, key=lambda r: r[0]), READS).coalesce(1)
    want = words(dna)
    got = buckets.whole_kmer_counts(reads).select(S.unpack("kmer").alias("kmer"), "n").collect()
    assert {r.kmer: r.n for r in got} == want and len(got) == len(want)
    assert {r.kmer for r in buckets.whole_kmer_counts(reads, min_n=5).select(S.unpack("kmer").alias("kmer")).collect()} == {w for w, n in want.items() if n >= 5}
    assert buckets.whole_kmer_counts(reads.limit(0)).count() == 0


def test_profile_of_reads_with_equal_ids(spark, dna):
    reads = spark.createDataFrame(dna, READS)
    listed = sorted(w for w, n in words(dna).items() if n >= 3) + ["ACGT" * 5]
    got = profiles.profiles(reads, spark.createDataFrame([(w,) for w in [*listed, "ACGN" * 5]], "kmer string"), flat=False).collect()
    assert {(r.kmer, r.pos, r.base): r.n for r in got} == counted(dna, set(listed)) and len(got) == len(counted(dna, set(listed)))
    assert profiles.profiles(reads, spark.createDataFrame([], "kmer string"), flat=False).count() == 0


def test_profile_moves_only_what_is_found(spark, dna):
    reads = spark.createDataFrame(dna * 20, READS)
    listed = sorted(words(dna))[:5]
    packets = buckets.profile_packets(reads, np.array([int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in listed]))
    hits = sum(n for (w, pos, _), n in counted(dna * 20, set(listed)).items() if pos == 100)
    assert packets.agg(F.sum("hits")).first()[0] >= hits
    assert packets.agg(F.sum(F.length("data"))).first()[0] < 60 * max(hits, 100)
    plan = profiles.profiles(reads, spark.createDataFrame([(w,) for w in listed], "kmer string"), flat=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_sums_of_many_rows():
    around = np.zeros((150_000, buckets.PROFILE_WIDTH), dtype=np.uint8)
    h, cells = buckets._cells(np.array([1, 2], dtype=np.uint64), np.array([149_999, 1]), around)
    assert cells[:, 0].tolist() == [[149_999, 0, 0, 0], [1, 0, 0, 0]]


def test_flat_profile_of_reads_with_equal_ids(spark, dna):
    listed = sorted(w for w, n in words(dna).items() if n >= 3)
    got = profiles.profiles(spark.createDataFrame(dna, READS), spark.createDataFrame([(w,) for w in listed], "kmer string")).collect()
    assert {(r.kmer, r.pos, r.base) for r in got} == set(counted(dna, set(listed))) and {r.n for r in got} == {1}
    assert len(got) == len(counted(dna, set(listed)))


def test_positions_of_reads(spark, dna):
    listed = sorted(w for w, n in words(dna).items() if n >= 3)
    got = profiles.reads_positions(spark.createDataFrame(dna, READS), spark.createDataFrame([(w,) for w in listed], "kmer string")).collect()
    assert sorted((r.kmer, r.pos) for r in got) == sorted({(w, pos) for w, pos, _ in counted(dna, set(listed))}) and {r.n for r in got} == {1}


def test_validity_of_reads(spark, dna):
    listed = spark.createDataFrame([(w,) for w in sorted(words(dna))], "kmer string")
    bad = [r.kmer for r in profiles.reads_invalid(spark.createDataFrame(dna, READS), listed).collect()]
    own = Counter((w, pos) for w, pos, _ in counted(dna, set(words(dna))) if 100 <= pos < 120)
    places = Counter(w for w, _ in own)
    assert bad == [] == [w for w, n in places.items() if n != 20 or max(own[w, p] for p in range(100, 120)) != 1]
    cells = np.zeros((3, buckets.PROFILE_WIDTH, 4), dtype=np.int64)
    cells[:, 100:120, 0] = 1
    cells[1, 105, 1] = cells[2, 50, 0] = 1
    cells[2, 119, 0] = 0
    assert buckets.unsound_rows(np.array([1, 2, 3]), cells)["kmer"].to_pylist() == buckets.letters(np.array([2, 3]), 20).to_pylist()


def test_entropy_of_reads(spark, dna):
    listed = spark.createDataFrame([(w,) for w in sorted(words(dna))], "kmer string")
    reads = spark.createDataFrame(dna, READS)
    got = {r.kmer: r.avg_entropy for r in profiles.reads_entropy(reads, listed).collect()}
    want = {r.kmer: r.avg_entropy for r in profiles.average_entropy(profiles.profiles(reads, listed, False)).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_deciles_of_reads(spark, dna):
    listed = spark.createDataFrame([(w,) for w in sorted(words(dna))], "kmer string")
    ranked = profiles.reads_entropy(spark.createDataFrame(dna, READS), listed)
    order = sorted((r.avg_entropy, r.kmer) for r in ranked.collect())
    got = sorted((r.decile, r.kmer) for r in profiles.entropy_deciles(ranked).collect())
    assert got == [(i, order[int(i * (len(order) - 1) / 10 + 0.5)][1]) for i in range(11)]


def test_normalized_query_writes_no_other_profiles(spark, tmp_path, monkeypatch):
    from seqloom.plans import kmer_queries

    kept = []
    monkeypatch.setattr(kmer_queries, "Scratch", lambda s, f=kmer_queries.Scratch: kept.append(f(s)) or kept[-1])
    spark.createDataFrame([(i, "s", "abcdefghij klmnopqrstuvwxyz" * 2 + "abcde" * (1 + i % 3)) for i in range(40)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bits = kmer_queries.profile_normalized(spark, str(tmp_path))
    first = {r.kmer for r in kmer_queries.profile_entropy_rank(spark, str(tmp_path)).orderBy("avg_entropy", "kmer").limit(60).collect()}
    assert {r.kmer for r in bits.collect()} == first
    assert all({r.kmer for r in t.select("kmer").distinct().collect()} <= first for s in kept for t in s.tables.values())


def test_merge_of_packed_profiles(spark, dna):
    reads = spark.createDataFrame(dna, READS)
    listed = sorted(w for w, n in words(dna).items() if n >= 3)
    whitelist = spark.createDataFrame([(w,) for w in listed], "kmer string")
    parts = [profiles.packed_profiles(reads.where(F.col("sample_id") % 3 == i), whitelist) for i in range(3)]
    got = profiles.unpacked(P.merge("packed profile", *parts)).collect()
    assert {(r.kmer, r.pos, r.base): r.n for r in got} == counted(dna, set(listed)) and len(got) == len(counted(dna, set(listed)))
