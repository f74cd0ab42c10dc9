"""Operators on small fixed relations."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import association, clustering, enrichment, graph, population, profiles, ranking, sampling
from seqloom.operators import presence as P
from seqloom.schema import COUNTS, PRESENCE


def counts(spark, d):
    return spark.createDataFrame([(str(k), v) for k, v in d.items()], COUNTS)


def has(spark, d):
    return spark.createDataFrame([(str(k), v) for k, v in d.items()], PRESENCE)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_merge_counts(spark):
    a, b, c = ({1: 2, 2: 1, 6: 5}, {0: 4, 1: 10, 2: 3, 4: 2}, {2: 1, 4: 5})
    want = {"0": 4, "1": 12, "2": 5, "4": 7, "6": 5}
    x, y, z = (counts(spark, d) for d in (a, b, c))
    assert pairs(P.merge_counts(x, y, z)) == want == pairs(P.merge_counts(P.merge_counts(z, x), y)) == pairs(P.merge("count", y, z, x))
    assert pairs(P.merge_counts(x.limit(0))) == {}
    with pytest.raises(ValueError):
        P.merge("sum", x)


def test_merge_presence(spark):
    frames = [{1: [1, 3], 2: [5, 8], 6: [10, 14]}, {0: [0, 4], 1: [2, 5], 2: [2, 9], 4: [0, 4]}, {2: [1, 4], 4: [1, 3]}]
    assert pairs(P.merge_presence(*[has(spark, f) for f in frames])) == {"0": [0, 4], "1": [1, 2, 3, 5], "2": [1, 2, 4, 5, 8, 9], "4": [0, 1, 3, 4], "6": [10, 14]}


def test_sample_kmers_thresholds(spark):
    reads = spark.createDataFrame([(0, 0, "AAAAAA"), (1, 0, "AAAC")], "sample_id bigint, read_no int, seq string")
    assert [tuple(r) for r in P.sample_kmers(reads, 3).collect()] == [(0, "AAA", 4)]
    assert {tuple(r) for r in P.sample_kmers(reads, 3, 1, 3).collect()} == {(0, "AAA", 3), (1, "AAA", 1), (1, "AAC", 1)}


def test_presence_matrix_keeps_empty_samples(spark):
    rows = pairs(P.presence_matrix(has(spark, {"a": [0, 2], "b": []}), 4))
    assert rows == {"a": [1, 0, 1, 0], "b": [0, 0, 0, 0]}
    with pytest.raises(Exception, match="n_samples"):
        P.presence_matrix(has(spark, {"a": [4]}), 4).collect()


def test_components(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 7), (6, 9), (9, 10), (8, 10), (7, 8), (3, 3)], "src bigint, dst bigint")
    got = pairs(graph.components(spark.range(12), edges))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, **{v: 5 for v in range(5, 11)}, 11: 11}
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).orderBy(F.desc("src"))
    assert pairs(graph.components(spark.range(12), turned)) == got


def test_long_chain_and_empty_graph(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src bigint, dst bigint")
    assert {r.component for r in graph.components(spark.range(301), chain).collect()} == {0}
    assert pairs(graph.components(spark.range(2), chain.limit(0))) == {0: 0, 1: 1}


def test_supplier_parts_take_every_row(spark, tmp_path):
    from seqloom.plans import relation_queries

    items = [(1, 7, 50, 0.05), (2, 7, 10, 0.05), (2, 8, 50, 0.0), (3, 9, 1, 0.1), (4, 9, 2, 0.0), (3, 9, 1, 0.1)]
    spark.createDataFrame(items, "l_suppkey bigint, l_partkey bigint, l_quantity bigint, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 6)], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    least = {v: v for v in [*range(1, 6), *((1 << 40) + p for _, p, _, _ in items)]}
    for _ in least:
        for a, p, _, _ in items:
            least[a] = least[(1 << 40) + p] = min(least[a], least[(1 << 40) + p])
    assert pairs(relation_queries.supplier_part_components(spark, str(tmp_path))) == least
    assert {least[v] for v in range(1, 6)} == {1, 3, 5}


def test_graph_edits(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src bigint, dst bigint")
    more = spark.createDataFrame([(5, 4)], "src bigint, dst bigint")
    assert {tuple(r) for r in graph.add_edges(e, more).collect()} == {(1, 2), (4, 5)}
    assert graph.delete_edges(e, e).count() == 0 and graph.has_edge(e, 2, 1) and not graph.has_edge(e, 1, 3)
    assert pairs(graph.degrees(e)) == {1: 1, 2: 1}


def test_cluster_and_medoid(spark):
    base = list(range(60))
    sets = {"a": base, "b": base[:-1], "c": base[1:], "d": list(range(100, 160)), "e": [1, 2]}
    h = has(spark, sets)
    clusters = clustering.cluster(h, 1000)
    assert pairs(clusters) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    rows = clustering.medoids(clusters, h, 1000).collect()
    assert [(r.component, r.size, r.medoid) for r in rows] == [("a", 3, "a"), ("d", 1, "d"), ("e", 1, "e")] and rows[1].rms is None
    assert [r["size"] for r in clustering.size_quantiles(clusters, 2).orderBy("tile").collect()] == [3, 1, 1]
    with pytest.raises(Exception, match="n_samples"):
        clustering.cluster(h, 10).collect()


def test_medoid_of_repeated_sets(spark):
    sets = {"a": range(40), "b": range(1, 40), "c": range(1, 40), "d": range(2, 40), "e": [7], "f": [7]}
    clusters = spark.createDataFrame([(k, "e" if k in "ef" else "a") for k in sets], "kmer string, component string")
    found = {r.component: r for r in clustering.medoids(clusters, has(spark, {k: list(v) for k, v in sets.items()}), 100).collect()}

    def far(x, y):
        x, y = set(x), set(y)
        both, either = len(x & y), len(x | y)
        return 1 - both / either / 2 - (100 - either) / (100 - both) / 2

    rms = {k: math.sqrt(sum(far(sets[k], sets[o]) ** 2 for o in "abcd" if o != k) / 3) for k in "abcd"}
    assert (found["a"].size, found["a"].medoid) == (4, min("abcd", key=lambda k: (round(rms[k], 12), k))) and found["a"].rms == pytest.approx(min(rms.values()))
    assert (found["e"].size, found["e"].medoid, found["e"].rms) == (2, "e", 0)


def test_gram_is_the_product_of_the_matrix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((300, 40)) < 0.2
    want = x.T.astype(int) @ x
    h = has(spark, {f"k{r}": np.flatnonzero(x[r]).tolist() for r in range(300)})
    assert {(r.i, r.j): r.shared for r in population.gram(h).collect()} == {(i, j): want[i, j] for i in range(40) for j in range(i, 40) if want[i, j]}
    monkeypatch.setattr(population, "CELLS", 100)
    monkeypatch.setattr(population, "TILE", 7)
    assert (population.gram_matrix(population.gram(h), list(range(40))) == want).all()
    nothing = spark.createDataFrame([("a", None), ("b", []), ("c", [None])], "kmer string, samples array<bigint>")
    assert population.gram(nothing).count() == 0 and population.gram(nothing.limit(0)).count() == 0


def test_block_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 12)) < rng.random(12) * 0.6 + 0.2
    h = has(spark, {f"k{r}": np.flatnonzero(x[r]).tolist() for r in range(400)})
    keys = population.subset_keys(h, 2, 4).select("kmer").collect()
    m = np.array([x[int(r.kmer[1:])] for r in keys], dtype=float).T
    m -= m.mean(0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    scores = population.standard_scores(u[:, :2] * s[:2])
    d = population.pca_distances(scores)
    got = population.block_distances(h, list(range(12)), steps=2)
    block = got[(got.step == 0) & (got.block == 1)]
    assert block.distance.to_numpy() == pytest.approx(d[np.triu_indices(12, 1)])
    assert len(got) == 2 * 3 * 66 and np.sqrt((got.groupby(["step", "block"]).distance.apply(lambda v: (v**2).sum()))).to_numpy() == pytest.approx(1 / math.sqrt(2))
    assert len(population.block_distances(h, list(range(12)), steps=2, halves=True)) == 2 * 3 * 66


def test_relative_sketch_bound(spark):
    h = clustering.sketches(has(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": [9]}))
    assert clustering.candidates(h).count() == 0
    assert [tuple(r) for r in clustering.candidates(h, relative=True).collect()] == [("a", "b", 3)]


def test_sampling(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("kmer"))
    assert sampling.sample(df, n=7).count() == 7 and sampling.sample(df, n=600).count() == 500
    assert {r.kmer for r in sampling.sample(df, n=50, seed=1).collect()} != {r.kmer for r in sampling.sample(df, n=50).collect()}
    assert 20 < sampling.sample(df, r=10).count() < 90
    for bad in ({}, {"n": 1, "r": 2}):
        with pytest.raises(ValueError):
            sampling.sample(df, **bad)
    with pytest.raises(ValueError):
        sampling.sample_exact(df, 0, "kmer")


def test_reservoir_frequencies(spark):
    df = spark.range(10)
    hits = np.zeros(10)
    trials = spark.range(2000).select(F.col("id").alias("seed")).join(df.select(F.col("id").alias("x")), F.lit(True))
    from pyspark.sql import Window as W

    from seqloom.functions.sequences import portable_hash

    order = portable_hash(F.concat(F.col("x").cast("string"), F.lit("#"), F.col("seed").cast("string")))
    picked = trials.withColumn("k", F.row_number().over(W.partitionBy("seed").orderBy(order))).where("k <= 3")
    for r in picked.groupBy("x").count().collect():
        hits[r.x] = r["count"]
    assert (np.abs(hits - 600) < 120).all()


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 60
    z, x = rng.normal(size=(n, 2)), (rng.random((n, 3)) < 0.4).astype(float)
    x[:, 2] = 1
    y = 1 + z @ [0.5, -2] + 0.7 * x[:, 0] + rng.normal(size=n)
    cov = spark.createDataFrame([(i, float(y[i]), float(z[i, 0]), float(z[i, 1])) for i in range(n)] + [(n, None, 1.0, 1.0)], "sample_id bigint, y double, z0 double, z1 double")
    h = has(spark, {f"k{j}": [i for i in range(n) if x[i, j]] + [n] for j in range(3)})
    rows = {r.key: r for r in association.associate(h, cov, "y").collect()}
    for j in range(2):
        d = np.column_stack([z, np.ones(n), x[:, j]])
        b, rss, *_ = np.linalg.lstsq(d, y, rcond=None)
        se = np.sqrt(rss[0] / (n - 4) * np.diag(np.linalg.inv(d.T @ d)))
        r = rows[f"k{j}"]
        assert [r.z0_coef, r.z1_coef, r.const_coef, r.kmer_coef] == pytest.approx(b.tolist())
        assert r.rsquared == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum()) and r.n == x[:, j].sum()
        assert (r.kmer_coef_975 - r.kmer_coef_025) / 2 == pytest.approx(2.0032407188478727 * se[3], rel=1e-6)
    assert rows["k2"].degenerate and rows["k2"].kmer_coef is None and rows["k2"].n == n
    sig, rest = association.split_significant(association.associate(h, cov, "y"))
    assert sig.count() + rest.count() == 3
    with pytest.raises(ValueError):
        association.associate(h, cov, "y", family="probit")


def test_logit(spark):
    rng = np.random.default_rng(1)
    x = rng.random(200) < 0.5
    y = rng.random(200) < np.where(x, 0.8, 0.3)
    cov = spark.createDataFrame([(i, float(y[i])) for i in range(200)], "sample_id bigint, y double")
    r = association.associate(has(spark, {"k": np.flatnonzero(x).tolist()}), cov, "y", family="logit").first()
    odds = lambda m: np.log(y[m].mean() / (1 - y[m].mean()))
    assert r.kmer_coef == pytest.approx(odds(x) - odds(~x), abs=1e-6) and r.const_coef == pytest.approx(odds(~x), abs=1e-6)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(2)
    m = (rng.random((40, 8)) < 0.5).astype(float)
    h = has(spark, {f"k{j:02d}": np.flatnonzero(m[j]).tolist() for j in range(40)})
    loadings, scores, share = population.population_structure(h, list(range(8)), 3)
    x = m.T - m.T.mean(0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert share == pytest.approx((s**2 / (s**2).sum())[:3])
    got = np.zeros((3, 40))
    for r in loadings.collect():
        got[r.comp, int(r.kmer[1:])] = r.loading
    for c in range(3):
        assert np.abs(got[c]) == pytest.approx(np.abs(v[c]), abs=1e-8) and got[c][np.abs(got[c]).argmax()] > 0
    own = P.explode_presence(h)
    raw = {(r.sample_id, r.comp): r.score for r in population.project(own, loadings).collect()}
    assert raw[(3, 1)] == pytest.approx(m.T[3] @ got[1])
    assert np.abs(scores["pc0"]).to_numpy() == pytest.approx(np.abs(u[:, 0] * s[0]), abs=1e-8)


def test_small_structure_helpers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = population.mds(d)
    assert np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) == pytest.approx(d, abs=1e-4)
    assert np.linalg.norm(np.triu(population.pca_distances(x))) == pytest.approx(1 / np.sqrt(2))
    z = population.mini_pca(x @ x.T, np.arange(8), np.arange(8, 12))
    assert z.mean(0) == pytest.approx([0, 0]) and z.std(0) == pytest.approx([1, 1])
    g = x @ x.T
    assert population.cosine_dissimilarity(g).diagonal() == pytest.approx(np.zeros(12)) and population.euclidean(g) == pytest.approx(d, abs=1e-6)


def test_reference_kmers_and_enrichment(spark):
    kmers = spark.createDataFrame([("AAAC", 0), ("CCCA", 1)], "kmer string, idx bigint")
    aln = spark.createDataFrame([("g1|x", 40, "TTAAACTT"), ("g1|x", 10, "CCCA"), ("*", 60, "CCCA"), ("g2|y", 30, "TGGG")], "rname string, mapq int, seq string")
    genes = enrichment.reference_kmers(aln, kmers, 4, "g[0-9]")
    assert pairs(genes) == {"g1": [0], "g2": [1]}
    with pytest.raises(ValueError):
        enrichment.number_kmers(kmers.union(kmers))
    sig = spark.createDataFrame([("a", list(range(10))), ("b", [10])], "gene string, kmers array<bigint>")
    non = spark.createDataFrame([("b", list(range(20, 60))), ("c", [70])], "gene string, kmers array<bigint>")
    rows = enrichment.gene_enrichment(sig, non).collect()
    assert [(r.gene, r.a, r.b, r.c, r.d, r.significant) for r in rows] == [("a", 10, 1, 0, 41, True), ("b", 1, 10, 40, 1, False)]
    assert {r.gene for r in enrichment.found_genes(sig, non).collect()} == {"a", "b", "c"}


def test_group_enrichment_and_shares(spark):
    found = spark.range(20).select(F.col("id").alias("gene"))
    enr = spark.range(5).select(F.col("id").alias("gene"))
    groups = spark.range(10).select(F.col("id").alias("gene"), F.when(F.col("id") < 5, "x").otherwise("y").alias("ko"))
    rows = enrichment.group_enrichment(found, enr, groups).collect()
    assert [(r.ko, r.sp, r.nsp, r.snp, r.nsnp, r.odds, r.significant) for r in rows] == [("x", 5, 0, 0, 15, -1.0, True)]
    assert enrichment.without_group(found, groups).count() == 10
    with pytest.raises(ValueError):
        enrichment.group_enrichment(enr, found, groups)
    items = spark.createDataFrame([("a",)] * 50 + [("b",)] * 48 + [("c",), (None,)], "p string")
    assert {r.name: r.share for r in enrichment.shares(items, ["p"]).collect()} == pytest.approx({"a": 0.5, "b": 0.48, "Other": 0.01})


def test_categories(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "ko int")
    cats = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (3, "z")], "ko int, category string")
    out = enrichment.category_counts(keys, keys.where("ko = 1"), cats, excluded=("z",), top=1)
    assert [tuple(r) for r in out.collect()] == [("x", 2, 1)]
    with pytest.raises(ValueError):
        enrichment.category_counts(keys.union(spark.createDataFrame([(9,)], "ko int")), keys, cats)


def test_profile_fill(spark):
    found = spark.createDataFrame([("k", 2, "GTACGTAGTAGATAGGTGCAGCGATGAACCGTCGACA"), ("k", 2, "ACACGTAGTAGATAGGTGCAGCGATGAACCGTCGACT")], "kmer string, kpos int, seq string")
    rows = {r.pos: [r.A, r.C, r.G, r["T"]] for r in profiles.wide(profiles.fill(found)).collect()}
    assert (rows[98], rows[99], rows[100], rows[101], rows[133], rows[134]) == ([1, 0, 1, 0], [0, 1, 0, 1], [2, 0, 0, 0], [0, 2, 0, 0], [0, 2, 0, 0], [1, 0, 0, 1])
    assert {r.n for r in profiles.flatten(profiles.fill(found)).collect()} == {1}
    assert profiles.positions_seen(profiles.fill(found)).count() == 37


def test_profile_rank_and_validity(spark):
    k = "ACGTACGTACGTACGTACGA"
    reads = spark.createDataFrame([(0, 0, "TT" + k + "GG"), (1, 0, "TA" + k + "Gn")], "sample_id bigint, read_no int, seq string")
    p = profiles.profiles(reads, spark.createDataFrame([(k,)], "kmer string"), flat=False)
    assert profiles.invalid(p).count() == 0
    assert profiles.invalid(p.union(spark.createDataFrame([(k, 105, "A", 1)], p.schema))).count() == 1
    ranked = profiles.sort_by_entropy(p)
    assert ranked.count() == 1 and profiles.entropy_deciles(ranked).count() == 11
    assert profiles.normalized_profiles(p).where("fraction = 0.5").count() == 2


def test_ranks(spark):
    got = ranking.ranked(spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")), "v").collect()
    assert all(r.v == r.place for r in got) and len(got) == 1000


def test_logit_steps_cost_distinct_cases(spark):
    y, z, x = [0, 1, 0, 1, 1, 0, 1, 0], [1.0, 2.0, 1.5, 0.5, 3.0, 2.5, 1.0, 2.0], [0, 1, 1, 0, 1, 0, 1, 0]
    assert [len(a) for a in association.alike(np.tile(y, 50).astype(float), np.tile(z, 50)[:, None])] == [400, 8, 8, 8]

    def fit(times):
        cov = spark.createDataFrame([(i, float(y[i % 8]), z[i % 8]) for i in range(8 * times)], "sample_id bigint, y double, z double")
        return association.associate(has(spark, {"k": [i for i in range(8 * times) if x[i % 8]] + [0 if x[0] else 1, 10**9]}), cov, "y", family="logit").first()

    one, many = fit(1), fit(50)
    assert (one.n, many.n) == (4, 200) and not one.degenerate and not many.degenerate
    assert many.kmer_coef == pytest.approx(one.kmer_coef, abs=1e-9) and many.rsquared == pytest.approx(one.rsquared, abs=1e-9)
    assert many.kmer_coef_975 - many.kmer_coef == pytest.approx((one.kmer_coef_975 - one.kmer_coef) / 50**0.5, rel=1e-6)
