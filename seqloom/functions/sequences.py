"""Column expressions over DNA words. All stay inside the JVM; short or null sequences give no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import K
from .packing import LONGEST, packed_windows


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column | str) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(col(kmer), reverse_complement(kmer))


def starts(seq: Column, k: int) -> Column:
    """1-based starts of the windows of a sequence; none when it is shorter than k."""
    n = F.length(seq) - (k - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def free_windows(seq: Column | str, k: int = K) -> Column:
    """Array of (pos, word): 0-based windows without N or n, as written."""
    s = col(seq)
    every = F.transform(starts(s, k), lambda i: F.struct((i - 1).alias("pos"), F.substring(s, i, k).alias("word")))
    return F.filter(every, lambda w: ~w["word"].rlike("[Nn]"))


def canonical_kmers(seq: Column | str, k: int = K) -> Column:
    """Array of the canonical words of all N-free windows, in order, repeats kept.

    The reverse complement is made once for the sequence and sliced like the sequence itself.
    """
    s = col(seq)
    rc, n = reverse_complement(s), F.length(s)
    both = F.transform(starts(s, k), lambda i: F.struct(F.substring(s, i, k).alias("f"), F.substring(rc, n - i - (k - 2), k).alias("r")))
    return F.transform(F.filter(both, lambda w: ~w["f"].rlike("[Nn]")), lambda w: F.least(w["f"], w["r"]))


def pack(kmer: Column | str) -> Column:
    """Two bits a base as a positive BIGINT; numeric order is lexicographic order (up to 31 bases)."""
    return F.conv(F.translate(col(kmer), "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(packed: Column | str, k: int = K) -> Column:
    return F.translate(F.lpad(F.conv(col(packed).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed_or_fail(kmer: Column | str, k: int = K) -> Column:
    """pack() for words of exactly k bases; others are an error."""
    c = col(kmer)
    return F.when(F.length(c) == k, pack(c)).otherwise(F.raise_error(F.concat(F.lit("word of wrong length: "), c)).cast("bigint"))


def portable_hash(c: Column | str) -> Column:
    """60 bits of the md5 of a value's text: positive, stable, and the same in other SQL engines."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 15), 16, 10).cast("bigint")


def fast_hash(c: Column | str) -> Column:
    """60 positive bits of xxhash64, for partitioning inside one engine."""
    return F.xxhash64(col(c)).bitwiseAND(F.lit((1 << 60) - 1))


def minimizer(kmer: Column | str, m: int = 8, hasher=portable_hash) -> Column:
    """Least hash of the canonical m-letter words of a k-mer."""
    return F.array_min(F.transform(canonical_kmers(kmer, m), hasher))


def in_part(c: Column | str, part: int, parts: int, hasher=portable_hash) -> Column:
    """Whether a value belongs to part `part` (0-based) of `parts`."""
    if not 0 <= part < parts:
        raise ValueError(f"part {part} of {parts}")
    return F.pmod(hasher(c), F.lit(parts)) == part


def with_canonical_kmers(reads: DataFrame, k: int = K, packed: bool = False) -> DataFrame:
    """sample_id and one kmer per N-free window of each read.

    Packed words (8 bytes) are made batch by batch in numpy. Else, and for streams, window starts are
    exploded and the words cut by plain expressions, so all of it is compiled code; the reverse complement
    is made once per read.
    """
    if packed and k <= LONGEST and not reads.isStreaming:
        return packed_windows(reads, k, ["sample_id"])
    n = F.length("seq")
    long = reads.where(n >= k).select("sample_id", "seq", reverse_complement("seq").alias("rc"), F.explode(F.sequence(F.lit(1), n - (k - 1))).alias("i"))
    word, other = F.substring("seq", F.col("i"), F.lit(k)), F.substring("rc", n - F.col("i") - (k - 2), F.lit(k))
    words = long.select("sample_id", word.alias("w"), other.alias("r")).where(~F.contains("w", F.lit("N")) & ~F.contains("w", F.lit("n")))
    kmer = F.least("w", "r")
    return words.select("sample_id", (pack(kmer) if packed else kmer).alias("kmer"))
