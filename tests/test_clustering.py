"""Candidates, clusters and medoids against brute force, and what they send."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import clustering, sketch_join
from seqloom.plans import adapters

plain = lambda c: F.col(c) if isinstance(c, str) else c


def near_copies(seed=1, groups=12, words=400):
    """Random sets, near copies and copies of them, sets of few members, and an empty one."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(groups):
        base = rng.choice(words, 60, replace=False)
        for _ in range(6):
            change = rng.random(60) < rng.choice([0, 0.02, 0.05, 0.2])
            sets.append(np.where(change, rng.integers(words, 2 * words, 60), base))
    sets += [rng.choice(words, n, replace=False) for n in (1, 1, 2, 3, 36, 37)] + [sets[0][:5], sets[0][:5], sets[0][:1], []]
    return {k: sorted({int(x) for x in s}) for k, s in enumerate(sets)}


def frame(spark, sets, **more):
    rows = [(k, s, *[m[k] for m in more.values()]) for k, s in sets.items()]
    return spark.createDataFrame(rows, "kmer bigint, samples array<bigint>" + "".join(f", {c} string" for c in more))


@pytest.fixture
def tiny(monkeypatch):
    """Blocks so small that all are cut."""
    for module, name, value in ((sketch_join, "BLOCK", 3), (sketch_join, "AT_ONCE", 16), (sketch_join, "SAMPLED", 40), (clustering, "COPIES", 2), (clustering, "SETS", 2), (clustering, "CROWDED", 0.1), (clustering, "COLUMNS", 7)):
        monkeypatch.setattr(module, name, value)


def wanted(sets, size, bound, relative, group=None):
    sketch = {k: set(s[:size]) for k, s in sets.items()}
    out = set()
    for a, b in itertools.combinations(sets, 2):
        shared = len(sketch[a] & sketch[b])
        if shared and shared >= (min(bound, len(sketch[a]), len(sketch[b])) if relative else bound) and (group is None or group[a] == group[b] is not None):
            out.add((a, b, shared))
    return out


@pytest.mark.parametrize("relative", [False, True])
def test_candidates_by_brute_force(spark, tiny, relative):
    sets = near_copies()
    h = clustering.sketches(frame(spark, sets), size=50, hasher=plain)
    assert sorted(map(tuple, clustering.candidates(h, relative=relative).collect())) == sorted(wanted(sets, 50, 37, relative))
    group = {k: None if k % 13 == 0 else "xy"[k % 2] for k in sets}
    h = clustering.sketches(frame(spark, sets, g=group), size=50, hasher=plain)
    assert sorted(map(tuple, clustering.candidates(h, group="g", relative=relative).collect())) == sorted(wanted(sets, 50, 37, relative, group))
    assert clustering.candidates(h.limit(0), relative=relative).count() == 0


def dual(x, y, n):
    both, either = len(x & y), len(x | y)
    return 0.0 if not either or n == both else 1 - both / either / 2 - (n - either) / (n - both) / 2


@pytest.mark.parametrize("cut", [True, False])
def test_clusters_and_medoids_by_brute_force(spark, request, cut):
    if cut:
        request.getfixturevalue("tiny")
    sets, n = near_copies(2), 800
    component = {k: k for k in sets}
    for a, b, _ in sorted(wanted(sets, 50, 37, False)):
        if dual(set(sets[a]), set(sets[b]), n) < 0.05:
            low, high = sorted((component[a], component[b]))
            component = {k: low if c == high else c for k, c in component.items()}
    h = frame(spark, sets)
    got = clustering.cluster(h, n, hasher=plain)
    assert {r.kmer: r.component for r in got.collect()} == component and got.count() == len(sets)
    found = {r.component: r for r in clustering.medoids(got, h, n).collect()}
    assert set(found) == set(component.values())
    for c, r in found.items():
        own = [k for k in sets if component[k] == c]
        far = {k: math.sqrt(sum(dual(set(sets[k]), set(sets[o]), n) ** 2 for o in own) / max(1, len(own) - 1)) for k in own}
        assert r["size"] == len(own) and r.medoid == min(own, key=lambda k: (round(far[k], 12), k))
        assert r.rms is None if len(own) == 1 else r.rms == pytest.approx(far[r.medoid], abs=1e-9)


def test_meeting_pairs_send_no_sketches(spark):
    """500 sets that all share 25 of 50 members: pairs that met carried their sketches before, 4.3 MB; now 0.7 MB are sent."""
    rng = np.random.default_rng(3)
    shared = list(range(25))
    sets = {k: shared + sorted(rng.choice(np.arange(100, 200), 25, replace=False).tolist()) for k in range(500)}
    h = clustering.sketches(frame(spark, sets), hasher=lambda c: F.xxhash64(c))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = sent()
        assert sorted(map(tuple, clustering.candidates(h).collect())) == sorted(wanted(sets, 50, 37, False))
        assert sent() - before < 2e6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.fixture
def sent(spark):
    """Bytes that were shuffled so far; without automatic broadcasts, as for tables of any size."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_far_sets_are_not_sent(spark, sent):
    """150 sets with like sketches that are far apart: 4.3 MB were sent before, now 0.4 MB."""
    rng = np.random.default_rng(4)
    sets = {k: sorted({*range(45), *rng.choice(np.arange(1000, 4000), 300, replace=False).tolist()}) for k in range(150)}
    sets |= {150: sets[7], 151: sets[8][:-1], 152: sets[8][:-3] + [5000]}
    before = sent()
    got = {r.kmer: r.component for r in clustering.cluster(frame(spark, sets), 10_000, hasher=plain).collect()}
    assert got == {k: k for k in range(150)} | {150: 7, 151: 8, 152: 8}
    assert sent() - before < 1e6


@pytest.mark.parametrize("relative", [False, True])
def test_sketches_without_partners_are_not_sent(spark, sent, relative):
    """3,000 sets of which 2 share enough: all sketches were sent twice before, 4.7 MB; now 2.3 MB are sent."""
    rng = np.random.default_rng(5)
    members = np.sort(rng.integers(1 << 60, size=(3000, 50)), axis=1)
    sets = dict(enumerate(members.tolist())) | {3000: sorted([*members[11, :49].tolist(), 1])}
    h = clustering.sketches(frame(spark, sets), hasher=plain)
    before = sent()
    assert list(map(tuple, clustering.candidates(h, min_shared=49, relative=relative).collect())) == [(11, 3000, 49)]
    assert sent() - before < 3e6


def test_word_sets_of_repeated_ids(spark, tmp_path, monkeypatch):
    rows = [(1, "alpha  beta\nALPHA the"), (2, "gamma"), (1, "gamma delta\tbeta"), (3, "a b"), (4, None), (None, "omega")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = adapters.doc_words(spark, str(tmp_path)).distinct()
    first = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")
    want = {(r.kmer, r.h) for r in words.select("kmer", first("sample_id").alias("h")).collect()}
    got = adapters.doc_word_sets(spark, str(tmp_path))
    assert {(r.kmer, r.h) for r in got.select("kmer", F.explode(F.transform("samples", adapters.word_hash)).alias("h")).collect()} == want
    assert sorted((r.kmer or 0, len(r.samples)) for r in got.collect()) == [(0, 1), (1, 4), (2, 1)]
    monkeypatch.setattr(adapters, "KNOWN_WORDS", 2)
    assert adapters.word_count(spark, str(tmp_path)) == words.select("sample_id").distinct().count() == 5
