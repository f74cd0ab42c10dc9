"""Positional base profiles round k-mers, as long relations (kmer, pos, base, n).

A profile has 220 positions: the k-mer at 100 to 119 and 100 on either side. Bases beyond are clipped,
N and n are missing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import entropy, smoothed_entropy
from ..functions.packing import LONGEST, packed_windows
from ..functions.sequences import free_windows, pack, reverse_complement, unpack
from ..schema import BASES, FLANK, K, PROFILE_WIDTH
from . import buckets, ranking


def occurrences(reads: DataFrame, whitelist: DataFrame, k: int = K) -> DataFrame:
    """kmer, kpos (0-based) and seq of every whitelisted window of the reads and their reverse complements.

    Reads that sample_id and read_no tell apart are looked up by packed windows, of which only those found
    are joined to their reads; of others each window carries its read.
    """
    if k <= LONGEST and {"sample_id", "read_no"} <= set(reads.columns):
        listed = whitelist.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).select(pack("kmer").alias("kmer")).distinct()
        found = packed_windows(reads, k, ["sample_id", "read_no"], strands=True).join(listed, "kmer", "left_semi")
        placed = found.join(reads.select("sample_id", "read_no", "seq"), ["sample_id", "read_no"])
        seq = F.when(F.col("strand") == 0, F.col("seq")).otherwise(reverse_complement("seq"))
        return placed.select(unpack("kmer", k).alias("kmer"), F.col("pos").alias("kpos"), seq.alias("seq"))
    both = reads.select("sample_id", F.explode(F.array("seq", reverse_complement("seq"))).alias("seq"))
    windows = both.select("sample_id", "seq", F.explode(free_windows("seq", k)).alias("w")).select("sample_id", "seq", F.col("w.word").alias("kmer"), F.col("w.pos").alias("kpos"))
    return windows.join(whitelist.select("kmer").distinct(), "kmer", "left_semi")


def fill(found: DataFrame) -> DataFrame:
    """kmer, pos, base, n: bases of the reads round each occurrence, the k-mer starting at position 100."""
    each = found.select("kmer", "kpos", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i"))
    every = each.select("kmer", "kpos", "i", F.substring("seq", F.col("i") + 1, F.lit(1)).alias("base")).where(F.col("base").isin(*BASES))
    placed = every.select("kmer", (F.col("i") + FLANK - F.col("kpos")).cast("int").alias("pos"), "base").where(F.col("pos").between(0, PROFILE_WIDTH - 1))
    return placed.groupBy("kmer", "pos", "base").agg(F.count("*").alias("n"))


def flatten(profile: DataFrame) -> DataFrame:
    """Counts as 0 or 1."""
    return profile.withColumn("n", F.least("n", F.lit(1).cast("bigint")))


def in_buckets(reads: DataFrame, k: int = K) -> bool:
    """Whether the reads are told apart, so that each is looked through once, by tasks that send only what they found."""
    return k == K and {"sample_id", "read_no"} <= set(reads.columns) and not reads.isStreaming


def profiles(reads: DataFrame, whitelist: DataFrame, flat: bool = True, k: int = K) -> DataFrame:
    filled = buckets.profile_rows(reads, whitelist, buckets.long_rows, buckets.LONG) if in_buckets(reads, k) else fill(occurrences(reads, whitelist, k))
    return flatten(filled) if flat else filled


def packed_profiles(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Profiles of reads that sample_id and read_no tell apart, for merging: their counts in packets."""
    return buckets.profile_rows(reads, whitelist, buckets.cell_packets, buckets.PACKETS)


def unpacked(packets: DataFrame) -> DataFrame:
    """The long form of packed profiles."""
    return buckets.unpack_rows(packets)


def reads_positions(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """positions_seen() of the profiles of reads, without their long form where reads are told apart."""
    return buckets.profile_rows(reads, whitelist, buckets.position_rows, buckets.POSITIONS) if in_buckets(reads) else positions_seen(profiles(reads, whitelist, False))


def reads_invalid(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """invalid() of the profiles of reads, likewise."""
    return buckets.profile_rows(reads, whitelist, buckets.unsound_rows, buckets.UNSOUND) if in_buckets(reads) else invalid(profiles(reads, whitelist, False))


def reads_entropy(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """average_entropy() of the profiles of reads, likewise."""
    return buckets.profile_rows(reads, whitelist, buckets.entropy_rows, buckets.ENTROPIES) if in_buckets(reads) else average_entropy(profiles(reads, whitelist, False))


def positions_seen(profile: DataFrame) -> DataFrame:
    """kmer, pos and 1 for each position that has any base."""
    return profile.where("n > 0").groupBy("kmer", "pos").agg(F.lit(1).cast("bigint").alias("n"))


def invalid(profile: DataFrame, k: int = K) -> DataFrame:
    """K-mers of which some own position has not exactly one base; none in a sound profile."""
    own = profile.where(F.col("pos").between(FLANK, FLANK + k - 1) & (F.col("n") > 0))
    bad = own.groupBy("kmer", "pos").agg(F.countDistinct("base").alias("bases")).groupBy("kmer").agg(F.count("*").alias("positions"), F.max("bases").alias("bases"))
    return bad.where((F.col("positions") != k) | (F.col("bases") != 1)).select("kmer")


def wide(profile: DataFrame) -> DataFrame:
    """kmer, pos and one count per base."""
    cells = [F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).cast("bigint").alias(b) for b in BASES]
    return profile.groupBy("kmer", "pos").agg(*cells)


def average_entropy(profile: DataFrame) -> DataFrame:
    """kmer and avg_entropy: smoothed entropy over all 220 positions, an empty one counting 0."""
    each = wide(profile).withColumn("e", smoothed_entropy([F.col(b) for b in BASES]))
    return each.groupBy("kmer").agg((F.sum("e") / PROFILE_WIDTH).alias("avg_entropy"))


def sort_by_entropy(profile: DataFrame) -> DataFrame:
    """kmer and avg_entropy in ascending order."""
    return average_entropy(profile).orderBy("avg_entropy", "kmer")


def entropy_deciles(ranked: DataFrame, n: int = 10) -> DataFrame:
    """decile, kmer, avg_entropy at ranks round(i * (rows - 1) / n)."""
    rows = ranked.count()
    numbered = ranking.ranked(ranked, "avg_entropy", "kmer")
    wanted = F.array(*[F.lit(math.floor(i * (rows - 1) / n + 0.5)) for i in range(n + 1)])
    tiles = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.get(wanted, i) == F.col("place"))
    return numbered.select(F.explode(tiles).alias("decile"), "kmer", "avg_entropy")


def normalize(profile: DataFrame) -> DataFrame:
    """Adds `fraction`: share of each base at its position; positions without counts stay 0."""
    w = W.partitionBy("kmer", "pos")
    total = F.sum("n").over(w)
    return profile.withColumn("fraction", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def information(profile: DataFrame) -> DataFrame:
    """kmer, pos, base, fraction and height: fraction times (2 - entropy of its position)."""
    share = normalize(profile)
    bits = wide(profile).withColumn("e", entropy([F.col(b) for b in BASES])).select("kmer", "pos", "e")
    return share.join(bits, ["kmer", "pos"]).select("kmer", "pos", "base", "fraction", (F.col("fraction") * (2.0 - F.col("e"))).alias("height"))


def normalized_profiles(profile: DataFrame, n: int = 60) -> DataFrame:
    """information() of the n profiles of least average entropy."""
    first = sort_by_entropy(profile).limit(n).select("kmer")
    return information(profile.join(F.broadcast(first), "kmer", "left_semi"))
