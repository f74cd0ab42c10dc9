"""Scalar functions: fixed cases and laws."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import arrays as A
from seqloom.functions import sequences as S
from seqloom.functions import stats as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_canonical_windows(spark):
    assert one(spark, x=S.canonical_kmers(F.lit("ATTAGGCAC"), 3)).x == ["AAT", "TAA", "CTA", "AGG", "GCC", "GCA", "CAC"]


def test_free_windows(spark):
    got = one(spark, x=S.free_windows(F.lit("ATTANGGAtagnnagtt"), 3)).x
    assert [(w.pos, w.word) for w in got] == list(zip([0, 1, 5, 6, 7, 8, 13, 14], ["ATT", "TTA", "GGA", "GAt", "Ata", "tag", "agt", "gtt"]))


@pytest.mark.parametrize("seq", ["", "A", "ACGTACGTACGTACGTACG", None])
def test_short_sequences_have_no_windows(spark, seq):
    df = spark.createDataFrame([(1, 0, seq)], "sample_id bigint, read_no int, seq string")
    assert S.with_canonical_kmers(df).count() == 0


def test_long_and_array_windows_agree(spark):
    df = spark.createDataFrame([(1, 0, "ACGTTGCANGGATCCATT" * 3), (2, 0, "nACGTACGTACGTACGTACGTT")], "sample_id bigint, read_no int, seq string")
    a = sorted(map(tuple, S.with_canonical_kmers(df, 7).collect()))
    b = sorted(map(tuple, df.select("sample_id", F.explode(S.canonical_kmers("seq", 7))).collect()))
    assert a == b and a


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGT", min_size=20, max_size=20), min_size=1, max_size=20))
def test_pack_keeps_order_and_canonical_is_stable(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.pack("w").alias("p"), S.unpack(S.pack("w")).alias("u"), S.canonical("w").alias("c"), S.canonical(S.reverse_complement("w")).alias("d")).collect()
    assert all(r.u == r.w and r.c == r.d for r in rows)
    assert sorted(r.w for r in rows) == [r.w for r in sorted(rows, key=lambda r: r.p)]


def test_word_of_wrong_length_fails(spark):
    with pytest.raises(Exception, match="wrong length"):
        one(spark, x=S.packed_or_fail(F.lit("ACG")))


@pytest.mark.parametrize("text,sep,parts", [("", ",", [""]), (",", ",", ["", ""]), ("a,b,c", ",", ["a", "b", "c"]), ("a,b,c,", ",", ["a", "b", "c", ""]), (",a,b,c", ",", ["", "a", "b", "c"]), ("a,b,,c", ",", ["a", "b", "", "c"]), ("hello world yeah", " ", ["hello", "world", "yeah"])])
def test_split(spark, text, sep, parts):
    assert one(spark, x=A.split_parts(F.lit(text), sep)).x == parts


def test_hash_parts_are_disjoint_and_cover(spark):
    df = spark.createDataFrame([(c,) for c in "abcdefghi"], "c string")
    parts = [{r.c for r in df.where(S.in_part("c", i, 4)).collect()} for i in range(4)]
    assert set().union(*parts) == set("abcdefghi") and sum(map(len, parts)) == 9
    with pytest.raises(ValueError):
        S.in_part("c", 4, 4)


def test_equal_values_hash_alike(spark):
    values = [4, 2, 3, 1, 4, 2, 3, 3, 1, 1, 1, 2, 3, 4]
    hashes = [r.h for r in spark.createDataFrame(list(enumerate(values)), "i int, v int").orderBy("i").select(S.portable_hash("v").alias("h")).collect()]
    assert all((values[i] == values[j]) == (hashes[i] == hashes[j]) for i in range(14) for j in range(14))


@pytest.mark.parametrize("a,b,d", [([1], [], 1), ([], [1], 1), ([1], [1], 0), ([1, 2], [1, 3], 2 / 3), ([1, 2, 3], [1, 3, 4], 0.5), ([], [], 0)])
def test_jaccard(spark, a, b, d):
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    x, y = arr(a), arr(b)
    assert one(spark, d=A.jaccard_distance(A.common(x, y), F.size(x), F.size(y))).d == pytest.approx(d)


@pytest.mark.parametrize("a,b,n", [([1], [], 1), ([], [1], 1), ([1], [1], 1), ([1, 2], [1, 3], 3), ([1, 2, 3], [1, 3, 4], 4)])
def test_dual_is_mean_of_both(spark, a, b, n):
    def dist(p, q):
        return 1 - len(p & q) / len(p | q) if p | q else 0

    p, q, whole = set(a), set(b), set(range(1, n + 1))
    want = (dist(p, q) + dist(whole - p, whole - q)) / 2
    lit = lambda v: F.lit(float(v))
    assert one(spark, d=A.dual_distance(lit(len(p & q)), lit(len(p)), lit(len(q)), lit(n))).d == pytest.approx(want)


@pytest.mark.parametrize("values,deltas", [([5, 10, 13, 27, 100], [5, 5, 3, 14, 73]), ([13, 5, 27, 100, 10], [13, -8, 22, 73, -90]), ([], [])])
def test_deltas(spark, values, deltas):
    x = F.array(*map(F.lit, values)).cast("array<bigint>")
    row = one(spark, d=A.to_deltas(x), r=A.from_deltas(A.to_deltas(x)))
    assert row.d == deltas and row.r == values


def test_places_and_tiles(spark):
    x = F.array(*map(F.lit, [3, 1, 7, 1, 7]))
    none = F.array().cast("array<int>")
    row = one(spark, lo=A.arg_min(x), hi=A.arg_max(x), no=A.arg_min(none), t=A.ntiles(4, F.array(*map(F.lit, [0, 1, 2, 3, 4, 5]))), e=A.ntiles(4, none))
    assert (row.lo, row.hi, row.no, row.t, row.e) == (1, 2, -1, [0, 1, 3, 4, 5], [])


FISHER = [
    (1, 1, 1, 1, 1, 0.833333333333333, 0.8333333333333335, 1),
    (1, 0, 0, 1, math.inf, 0.5, 1, 1),
    (0, 1, 1, 0, 0, 1, 0.5, 1),
    (1, 9, 11, 3, 0.0303030303030303, 0.9999663480953115, 0.001379728092610052, 0.002759456185220104),
    (0, 10, 12, 2, 0, 1, 3.365190469780604e-05, 6.730380939561209e-05),
    (60, 10, 30, 25, 5, 0.0001220652942110203, 0.9999777586419631, 0.00023568647189489372),
]


def test_fisher(spark):
    df = spark.createDataFrame([r[:4] for r in FISHER], "a bigint, b bigint, c bigint, d bigint")
    got = df.select("*", T.odds_ratio("a", "b", "c", "d").alias("o"), *[T.fisher("a", "b", "c", "d", t).alias(t[0]) for t in ("greater", "less", "two-sided")]).collect()
    want = {r[:4]: r[4:] for r in FISHER}
    for r in got:
        assert (r.o, r.g, r.l, r.t) == pytest.approx(want[(r.a, r.b, r.c, r.d)], abs=1e-11)


def exact_fisher(a, b, c, d):
    """The three p-values in whole numbers."""
    r1, r2, c1 = a + b, c + d, a + c
    ways = {x: math.comb(r1, x) * math.comb(r2, c1 - x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    total = sum(ways.values())
    picks = [x for x in ways if x >= a], [x for x in ways if x <= a], [x for x in ways if ways[x] * 10**7 <= ways[a] * (10**7 + 1)]
    return [sum(ways[x] for x in p) / total for p in picks]


def test_fisher_against_whole_numbers(spark):
    draw = np.random.default_rng(4)
    cells = [tuple(int(v) for v in draw.integers(0, top, 4)) for top in (4, 30, 700) for _ in range(25)]
    cells += [(0, 0, 0, 0), (2500, 0, 2400, 100), (3, 2900, 40, 2000), (900, 900, 900, 900), (0, 5, 0, 5), (5, 0, 5, 0)]
    df = spark.createDataFrame(cells, "a bigint, b bigint, c bigint, d bigint")
    for r in df.select("*", *[T.fisher("a", "b", "c", "d", t).alias(t[0]) for t in ("greater", "less", "two-sided")]).collect():
        assert [r.g, r.l, r.t] == pytest.approx(exact_fisher(r.a, r.b, r.c, r.d), rel=1e-8, abs=1e-300), r


def test_fisher_of_large_margins(spark):
    cells = map(F.lit, (50_000_000, 50_000_000, 50_010_000, 49_990_000))
    a, b, c, d = (x.cast("bigint") for x in cells)
    row = one(spark, l=T.fisher(a, b, c, d, "less"), t=T.fisher(a, b, c, d))
    # 50 million in 100 million against 50.01: z = -1.41421 (with the half-table correction -1.41407)
    assert row.l == pytest.approx(math.erfc(9999 / math.sqrt(5e7) / math.sqrt(2)) / 2, rel=1e-3) and row.t == pytest.approx(2 * row.l, rel=1e-3)


def test_fisher_errors(spark):
    with pytest.raises(Exception, match="negative"):
        one(spark, x=T.fisher(F.lit(-1), F.lit(1), F.lit(1), F.lit(1)))
    with pytest.raises(ValueError):
        T.fisher("a", "b", "c", "d", "up")


def test_tails_sum_to_one(spark):
    a, b, c, d = map(F.lit, (7, 12, 9, 4))
    row = one(spark, g=T.fisher(a, b, c, d, "greater"), l=T.fisher(a, b, c, d, "less"), n=T.fisher(F.lit(8), F.lit(11), F.lit(8), F.lit(5), "greater"))
    assert row.g + row.l - (row.g - row.n) == pytest.approx(1)


def test_student_t():
    t = np.array([0.3, 1.0, 5.0, 30.0])
    assert T.t_two_sided(t, np.full(4, 1.0)) == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-13)
    assert T.t_two_sided(t, np.full(4, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-9)
    assert T.t_two_sided(np.array([30.0]), np.array([100.0]))[0] == pytest.approx(8.4e-52, rel=0.01)
    assert T.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)


def test_entropies(spark):
    lits = lambda *v: [F.lit(float(x)) for x in v]
    row = one(spark, a=A.entropy(lits(1, 1, 0, 0)), b=A.smoothed_entropy(lits(4, 0, 0, 0)), c=A.cosine(F.array(*lits(1, 0)), F.array(*lits(1, 1))))
    assert row.a == 1 and row.b == pytest.approx(-(5 / 8) * math.log2(5 / 8)) and row.c == pytest.approx(1 / math.sqrt(2))


def test_text_helpers(spark):
    row = one(spark, a=A.cut_suffix(F.lit("x_12"), "x"), b=A.extract_name(F.lit("gi|g12|z"), "g[0-9]+"), c=A.percent_text(F.lit(1), F.lit(3), 1), d=A.json_safe(F.lit(math.inf)), e=A.restore_infinity(F.lit(-1.0)), f=A.round_div(F.lit(5), F.lit(2)))
    assert tuple(row) == ("x", "g12", "33.3%", -1.0, math.inf, 3)
    with pytest.raises(Exception, match="no match"):
        one(spark, b=A.extract_name(F.lit("zzz"), "g[0-9]+"))
