"""Queries over k-mers of the sequence view: extraction, counting, presence, partitions, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequences as S
from ..operators import buckets, sampling
from ..operators import presence as P
from ..operators import profiles as R
from ..scratch import Scratch
from .adapters import ABUNDANT_SQL, BUYERS_SQL, WINDOWS_SQL, buyers, h, reads, table
from .registry import query

MIN_SAMPLES = 8


def joined(c: str, sep: str = ","):
    return F.array_join(F.col(c).cast("array<string>"), sep)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per canonical k-mer; keys travel packed in 8 bytes."""
    packed = P.kmer_counts(S.with_canonical_kmers(reads(spark, sf_dir), packed=True))
    return packed.select(S.unpack("kmer").alias("kmer"), "n")


def abundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).where(F.col("n") >= MIN_SAMPLES)


def abundant_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted samples of those k-mers; words are packed until the arrays are made."""
    words = S.with_canonical_kmers(reads(spark, sf_dir), packed=True)
    has = P.presence(words, P.filter_counts(P.kmer_counts(words), MIN_SAMPLES))
    return has.select(S.unpack("kmer").alias("kmer"), "samples")


@query(f"WITH {WINDOWS_SQL} SELECT sample_id, count(*)::BIGINT AS n_windows, min(kmer) AS first_kmer FROM kmers GROUP BY sample_id")
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-free canonical windows of each sample."""
    return S.with_canonical_kmers(reads(spark, sf_dir)).groupBy("sample_id").agg(F.count("*").alias("n_windows"), F.min("kmer").alias("first_kmer"))


@query(f"WITH {WINDOWS_SQL} SELECT sample_id, read_no, count(*)::BIGINT AS n, min(pos) AS first_pos, max(pos) AS last_pos, max(word) AS last_word FROM windows WHERE word NOT LIKE '%N%' GROUP BY sample_id, read_no")
def free_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-free windows of each read, as written: number, first and last position, last word in order."""
    each = reads(spark, sf_dir).select("sample_id", "read_no", S.free_windows("seq").alias("w")).where(F.size("w") > 0)
    place = lambda f: f(F.transform("w", lambda x: x["pos"]))
    return each.select("sample_id", "read_no", F.size("w").cast("bigint").alias("n"), place(F.array_min).alias("first_pos"), place(F.array_max).alias("last_pos"), F.array_max(F.transform("w", lambda x: x["word"])).alias("last_word"))


@query(f"WITH {WINDOWS_SQL} SELECT kmer, count(DISTINCT sample_id)::BIGINT AS n FROM kmers GROUP BY kmer")
def canonical_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per canonical k-mer."""
    return counts(spark, sf_dir)


@query(f"WITH {WINDOWS_SQL} SELECT sample_id, kmer, least(count(*), 255)::BIGINT AS n FROM kmers GROUP BY sample_id, kmer HAVING count(*) >= 2")
def sample_kmers_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers seen twice or more in a sample."""
    return P.sample_kmers(reads(spark, sf_dir), packed=True).select("sample_id", S.unpack("kmer").alias("kmer"), "n")


@query(f"WITH {ABUNDANT_SQL} SELECT kmer, n FROM abundant")
def abundant_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of at least MIN_SAMPLES samples."""
    return abundant(spark, sf_dir)


@query(f"WITH {ABUNDANT_SQL} SELECT kmer, n FROM abundant ORDER BY n DESC, kmer LIMIT 100")
def top_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most shared k-mers."""
    return abundant(spark, sf_dir).orderBy(F.desc("n"), "kmer").limit(100)


@query(f"WITH {ABUNDANT_SQL} SELECT kmer, list_sum(list_transform(range(1, 21), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * (4 ** (20 - i))::BIGINT))::BIGINT AS packed, kmer AS unpacked, kmer <= reverse(translate(kmer, 'ACGT', 'TGCA')) AS is_canonical FROM abundant")
def kmer_pack2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of k-mers and back."""
    return abundant(spark, sf_dir).select("kmer", S.packed_or_fail("kmer").alias("packed"), S.unpack(S.pack("kmer")).alias("unpacked"), (F.col("kmer") == S.canonical("kmer")).alias("is_canonical"))


@query(f"WITH {ABUNDANT_SQL} SELECT kmer, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS samples FROM kmers WHERE kmer IN (SELECT kmer FROM abundant) GROUP BY kmer")
def presence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted samples of whitelisted k-mers."""
    return abundant_presence(spark, sf_dir).select("kmer", joined("samples").alias("samples"))


@query(f"WITH {BUYERS_SQL} SELECT kmer, array_to_string(list_sort(list(sample_id)), ',') AS samples FROM buyers GROUP BY kmer")
def presence_arrays_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over another relation: the customers of each part."""
    return P.presence(buyers(spark, sf_dir)).select("kmer", joined("samples").alias("samples"))


@query(f"""WITH {BUYERS_SQL}, d AS (SELECT kmer, sample_id, sample_id - coalesce(lag(sample_id) OVER (PARTITION BY kmer ORDER BY sample_id), 0) AS delta FROM buyers)
SELECT kmer, string_agg(delta::VARCHAR, ',' ORDER BY sample_id) AS deltas, string_agg(sample_id::VARCHAR, ',' ORDER BY sample_id) AS restored FROM d GROUP BY kmer""")
def presence_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample ids as differences, and back."""
    has = P.presence(buyers(spark, sf_dir)).select("kmer", A.to_deltas("samples").alias("d"))
    return has.select("kmer", joined("d").alias("deltas"), A.from_deltas("d").alias("r")).select("kmer", "deltas", joined("r").alias("restored"))


def buyers_by_flag(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return [rows.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("kmer"), F.col("o_custkey").alias("sample_id")) for f in "ANR"]


FLAGGED = "flagged AS (SELECT DISTINCT l_returnflag AS f, l_partkey AS kmer, o_custkey AS sample_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N', 'R'))"


@query(f"WITH {FLAGGED} SELECT kmer, count(*)::BIGINT AS n FROM flagged GROUP BY kmer")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the counts of three parts."""
    return P.merge("count", *[P.kmer_counts(b) for b in buyers_by_flag(spark, sf_dir)])


@query(f"WITH {FLAGGED} SELECT kmer, array_to_string(list_sort(list(sample_id)), ',') AS samples FROM flagged GROUP BY kmer")
def merge_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three parts, repeats kept."""
    return P.merge("has", *[P.presence(b) for b in buyers_by_flag(spark, sf_dir)]).select("kmer", joined("samples").alias("samples"))


@query(f"WITH {FLAGGED} SELECT kmer::VARCHAR AS gene, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS kmers FROM flagged GROUP BY kmer")
def merge_gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of index sets of three parts."""
    sets = [P.presence(b).select(F.col("kmer").cast("string").alias("gene"), F.col("samples").alias("kmers")) for b in buyers_by_flag(spark, sf_dir)]
    return P.merge("genes", *sets).select("gene", joined("kmers").alias("kmers"))


@query(f"WITH {BUYERS_SQL}, k AS (SELECT kmer, list(sample_id) AS s FROM buyers GROUP BY kmer) SELECT kmer, coalesce(array_to_string(list_sort(list_filter(s, lambda x: {h('x')} % 7 = 0)), ','), '') AS samples FROM k")
def sampled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample id in seven; keys left without any stay."""
    return sampling.sample(P.presence(buyers(spark, sf_dir)), s=7).select("kmer", joined("samples").alias("samples"))


@query("SELECT p_partkey, " + h("p_name") + " % 4 AS part FROM part")
def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash parts of a list of names, ids kept: the four parts are disjoint and cover it."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("path"))
    return P.union(tuple(sampling.file_part(names, i, 4).select("p_partkey", F.lit(i).cast("bigint").alias("part")) for i in range(4)))


@query(f"WITH {WINDOWS_SQL} SELECT kmer, count(DISTINCT sample_id)::BIGINT AS n FROM kmers WHERE {h('kmer')} % 5 = 2 GROUP BY kmer")
def kmer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for one hash part of the k-mers."""
    return P.kmer_counts(S.with_canonical_kmers(reads(spark, sf_dir)), part=2, parts=5)


@query("SELECT p_partkey, p_name FROM part WHERE " + h("p_partkey || '#0'") + " % 10 = 0")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a tenth of the rows."""
    return sampling.sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), key="p_partkey", r=10)


@query("SELECT p_partkey, p_name FROM part ORDER BY " + h("p_partkey || '#0'") + ", p_partkey LIMIT 50")
def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly fifty rows."""
    return sampling.sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), key="p_partkey", n=50)


MNZ = f"""{ABUNDANT_SQL}, words AS (SELECT kmer, n, least(substr(kmer, p::BIGINT, 8), reverse(translate(substr(kmer, p::BIGINT, 8), 'ACGT', 'TGCA'))) AS w FROM abundant, LATERAL unnest(range(1, 14)) AS t(p)),
mnz AS (SELECT kmer, n, min({h('w')}) AS mnz FROM words GROUP BY kmer, n)"""


@query(f"WITH {MNZ} SELECT kmer, mnz FROM mnz")
def minimizer_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizer of each k-mer."""
    return sampling.with_minimizer(abundant(spark, sf_dir)).select("kmer", "mnz")


@query(f"WITH {MNZ} SELECT mnz, count(*)::BIGINT AS keys, sum(n)::BIGINT AS size FROM mnz GROUP BY mnz")
def partition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes of the minimizer partitions, largest first."""
    return sampling.partition_sizes(sampling.with_minimizer(abundant_presence(spark, sf_dir)))


@query("""WITH k AS (SELECT s_nationkey::BIGINT AS kmer, list(s_suppkey) AS l FROM supplier GROUP BY s_nationkey), m AS (SELECT max(s_suppkey) AS top FROM supplier)
SELECT kmer, array_to_string(list_transform(range(0, top + 1), lambda i: CASE WHEN list_contains(l, i) THEN 1 ELSE 0 END), '') AS bits FROM k, m""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rows of a presence relation: suppliers by nation."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("kmer"), F.col("s_suppkey").alias("sample_id"))
    width = sup.agg(F.max("sample_id")).first()[0] + 1
    return P.presence_matrix(P.presence(sup), width).select("kmer", F.array_join(F.col("row").cast("array<string>"), "").alias("bits"))


PROFILE_SQL = f"""{ABUNDANT_SQL}, wl AS (SELECT kmer FROM abundant WHERE n >= 30),
both_ AS (SELECT seq FROM reads UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads),
occ AS (SELECT substr(seq, p::BIGINT, 20) AS kmer, p - 1 AS kpos, seq FROM both_, LATERAL unnest(range(1, length(seq) - 18)) AS t(p)),
hit AS (SELECT * FROM occ WHERE kmer IN (SELECT kmer FROM wl)),
placed AS (SELECT kmer, (i - 1 + 100 - kpos)::INT AS pos, substr(seq, i::BIGINT, 1) AS base FROM hit, LATERAL unnest(range(1, length(seq) + 1)) AS t(i)),
profile AS (SELECT kmer, pos, base, count(*)::BIGINT AS n FROM placed WHERE base <> 'N' AND pos BETWEEN 0 AND 219 GROUP BY kmer, pos, base),
wide AS (SELECT kmer, pos, sum(CASE WHEN base = 'A' THEN n ELSE 0 END) AS a, sum(CASE WHEN base = 'C' THEN n ELSE 0 END) AS c, sum(CASE WHEN base = 'G' THEN n ELSE 0 END) AS g, sum(CASE WHEN base = 'T' THEN n ELSE 0 END) AS t FROM profile GROUP BY kmer, pos),
smooth AS (SELECT kmer, pos, a + c + g + t + 4.0::DOUBLE AS s, a, c, g, t FROM wide),
ent AS (SELECT kmer, sum((CASE WHEN a > 0 THEN -((a + 1) / s) * log2((a + 1) / s) ELSE 0 END) + (CASE WHEN c > 0 THEN -((c + 1) / s) * log2((c + 1) / s) ELSE 0 END)
  + (CASE WHEN g > 0 THEN -((g + 1) / s) * log2((g + 1) / s) ELSE 0 END) + (CASE WHEN t > 0 THEN -((t + 1) / s) * log2((t + 1) / s) ELSE 0 END)) / 220 AS e FROM smooth GROUP BY kmer)"""


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of thirty samples or more."""
    packed = buckets.whole_kmer_counts(reads(spark, sf_dir, whole=True), min_n=30)
    return packed.select(S.unpack("kmer").alias("kmer"))


def profile(spark: SparkSession, sf_dir: str, flat: bool = False) -> DataFrame:
    return R.profiles(reads(spark, sf_dir), whitelist(spark, sf_dir), flat)


@query(f"WITH {PROFILE_SQL} SELECT kmer, pos, base, n FROM profile")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts round whitelisted k-mers, both strands."""
    return profile(spark, sf_dir)


@query(f"WITH {PROFILE_SQL} SELECT kmer, pos, base, least(n, 1)::BIGINT AS n FROM profile")
def profile_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts as 0 or 1."""
    return profile(spark, sf_dir, True)


@query(f"WITH {PROFILE_SQL} SELECT kmer, pos, 1::BIGINT AS n FROM profile GROUP BY kmer, pos")
def profile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with any base."""
    return R.reads_positions(reads(spark, sf_dir), whitelist(spark, sf_dir))


@query(f"WITH {PROFILE_SQL} SELECT kmer FROM (SELECT kmer, pos, count(DISTINCT base) AS b FROM profile WHERE pos BETWEEN 100 AND 119 GROUP BY kmer, pos) GROUP BY kmer HAVING count(*) <> 20 OR max(b) <> 1")
def profile_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers whose own positions aren't of one base: none."""
    return R.reads_invalid(reads(spark, sf_dir), whitelist(spark, sf_dir))


@query(f"WITH {PROFILE_SQL} SELECT kmer, pos, base, n FROM profile")
def merge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of three disjoint parts of the samples, merged: that of all."""
    listed, every = Scratch(spark).cut(whitelist(spark, sf_dir)), reads(spark, sf_dir)
    parts = [R.packed_profiles(every.where(F.coalesce(F.pmod("sample_id", F.lit(3)), F.lit(0)) == i), listed) for i in range(3)]
    return R.unpacked(P.merge("packed profile", *parts))


@query(f"WITH {PROFILE_SQL} SELECT kmer, round(e, 9) AS avg_entropy FROM ent")
def profile_entropy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by average entropy."""
    ranked = R.reads_entropy(reads(spark, sf_dir), whitelist(spark, sf_dir)).orderBy("avg_entropy", "kmer")
    return ranked.select("kmer", F.round("avg_entropy", 9).alias("avg_entropy"))


@query(f"""WITH {PROFILE_SQL}, r AS (SELECT kmer, e, row_number() OVER (ORDER BY round(e, 9), kmer) - 1 AS place, count(*) OVER () AS m FROM ent)
SELECT i::INT AS decile, kmer, round(e, 9) AS avg_entropy FROM r, LATERAL unnest(range(0, 11)) AS t(i) WHERE place = floor(i * (m - 1) / 10.0 + 0.5)""")
def entropy_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles at the deciles of average entropy."""
    ranked = R.reads_entropy(reads(spark, sf_dir), whitelist(spark, sf_dir)).select("kmer", F.round("avg_entropy", 9).alias("avg_entropy"))
    return R.entropy_deciles(Scratch(spark).cut(ranked))


@query(f"""WITH {PROFILE_SQL}, first_ AS (SELECT kmer FROM ent ORDER BY round(e, 9), kmer LIMIT 60),
f AS (SELECT p.kmer, p.pos, p.base, p.n / (w.a + w.c + w.g + w.t)::DOUBLE AS fraction, (w.a + w.c + w.g + w.t)::DOUBLE AS s, a, c, g, t FROM profile p JOIN wide w ON p.kmer = w.kmer AND p.pos = w.pos WHERE p.kmer IN (SELECT kmer FROM first_))
SELECT kmer, pos, base, round(fraction, 9) AS fraction, round(fraction * (2 - ((CASE WHEN a > 0 THEN -(a / s) * log2(a / s) ELSE 0 END) + (CASE WHEN c > 0 THEN -(c / s) * log2(c / s) ELSE 0 END)
  + (CASE WHEN g > 0 THEN -(g / s) * log2(g / s) ELSE 0 END) + (CASE WHEN t > 0 THEN -(t / s) * log2(t / s) ELSE 0 END))), 9) AS height FROM f""")
def profile_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and information heights of the sixty profiles of least entropy."""
    first = R.reads_entropy(reads(spark, sf_dir), whitelist(spark, sf_dir)).orderBy(F.round("avg_entropy", 9), "kmer").limit(60).select("kmer")
    bits = R.information(Scratch(spark).cut(R.profiles(reads(spark, sf_dir), first, False)))
    return bits.select("kmer", "pos", "base", F.round("fraction", 9).alias("fraction"), F.round("height", 9).alias("height"))
