"""Clustering of keys with near-identical presence: MinHash candidates, dual distance, components, medoids.

Keys with equal sketches (for clusters: equal sets) are one node, and nodes meet by the rarest of their hashes
(`sketch_join`), so neither copies nor very common hashes make pairs before the result. Clusters don't need each pair's
shared hashes: 64-byte parity bit sketches of the whole sets bound a pair's distance from below, and sets with their
sketches are only sent for pairs that can be an edge: while there are many, each component's best pair first, which
mostly settles the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import bottom_sketch, common, dual_distance, ntiles
from ..functions.sequences import portable_hash
from ..schema import MAX_DIST, MIN_SHARED, SKETCH
from ..scratch import Scratch
from . import graph
from .sketch_join import SMALL_ROWS, bit_sketches, meeting_nodes, similar_nodes, small

#: Copies of a node that meet in one task, and sets of a component of which a task compares as many with as many.
COPIES, SETS = 1024, 512
#: Rounds of best pairs, and the pairs for each node from which on they are worth one.
ROUNDS, CROWDED = 4, 4
#: Sample columns of a block that are held at once.
COLUMNS = 8192
#: 64-bit words of a set's bit sketch, and sets that are made bit sketches at a time.
WORDS, SETS_AT_ONCE = 8, 4096


def checked(has: DataFrame, n_samples: int) -> DataFrame:
    """Fails on a key with more samples than there are."""
    kind = dict(has.dtypes)["samples"]
    too_many = F.raise_error(F.lit("key with more samples than n_samples")).cast(kind)
    return has.withColumn("samples", F.when(F.size("samples") > n_samples, too_many).otherwise(F.col("samples")))


def sketches(has: DataFrame, key: str = "kmer", size: int = SKETCH, hasher=portable_hash) -> DataFrame:
    return has.select("*", bottom_sketch("samples", size, hasher).alias("sketch"))


def _nodes(rows: DataFrame, key: str, groups: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys (key, node, len and more), nodes (node, grp, sketch, len, rep) and copies (node, times, rep: the least key): one node for each different `value` in a group.

    rows: key, groups, value, len, sketch; without key or group, or with a null sketch, they have no node.
    """
    grp = F.xxhash64(*groups) if groups else F.lit(0).cast("long")
    there = F.col("sketch").isNotNull()
    for c in (key, *groups):
        there &= F.col(c).isNotNull()
    seed = 0
    while True:
        number = lambda s: F.when(there, F.xxhash64(F.lit(s).cast("long"), *groups, "value"))
        keys = scratch.cut(rows.select(key, "len", "sketch", grp.alias("grp"), number(seed).alias("node"), number(~seed).alias("twin")))
        copies = keys.where("node is not null").groupBy("node").agg(F.min(key).alias("rep"), F.count("*").alias("times"), F.min("twin").alias("low"), F.max("twin").alias("high"))
        copies = scratch.cut(copies)
        if not copies.where("low <> high").head(1):  # else different values have one number by chance
            break
        seed += 1
    one = copies.select("node", F.col("rep").alias(key), "rep")
    nodes = scratch.cut(keys.join(small(one) if key_is_long(keys, key) else one, ["node", key]).select("node", "grp", "sketch", "len", "rep"))
    scratch.clean()
    return keys, nodes, copies


def key_is_long(df: DataFrame, key: str) -> bool:
    return dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")


def candidates(sketched: DataFrame, key: str = "kmer", min_shared: int = MIN_SHARED, group: str | None = None, relative: bool = False) -> DataFrame:
    """a, b (a < b) and shared: pairs of keys with min_shared common sketch hashes, within `group` if named.

    Sets of fewer members than min_shared never pair, unless `relative` lowers the bound to the smaller sketch.
    """
    scratch, groups, least = Scratch(sketched.sparkSession), [group] if group else [], max(min_shared, 1)
    rows = sketched.where(F.size("sketch") >= (1 if relative else least))
    keys, nodes, copies = _nodes(rows.select(key, *groups, F.col("sketch").alias("value"), F.size("sketch").cast("bigint").alias("len"), "sketch"), key, groups, scratch)
    pairs = similar_nodes(nodes.select("node", "grp", "sketch"), scratch, least, relative)
    # Members of a node with very many copies are dealt in blocks; there is one such node for COPIES keys at most.
    hot = scratch.cut(copies.where(F.col("times") > COPIES).select("node", F.ceil(F.col("times") / COPIES).cast("int").alias("blocks")), 1)
    blocks = lambda df, node: df.join(F.broadcast(hot.withColumnRenamed("node", node)), node, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = lambda df, node: blocks(df, node).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    members = blocks(keys.where("node is not null"), "node").select("node", F.pmod(F.xxhash64(key), "blocks").cast("int").alias("block"), F.col(key).alias("k"))
    expand = lambda df, node, to: dealt(df, node).join(members.toDF(node, "block", to), [node, "block"]).drop("block", node)
    apart = expand(expand(pairs, "a", "x"), "b", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
    several = keys.join(copies.where("times > 1").select("node"), "node").select("node", F.col(key).alias("a"), F.col("len").alias("shared"))
    alike = expand(several, "node", "b").where("a < b").select("a", "b", "shared")
    return apart.union(alike)


def pair_distances(pairs: DataFrame, has: DataFrame, n_samples: int, key: str = "kmer") -> DataFrame:
    """Adds the dual distance of a and b."""
    sets = has.select(key, "samples")
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    size = lambda c: F.size(c).cast("double")
    return both.withColumn("dist", dual_distance(common("xa", "xb").cast("double"), size("xa"), size("xb"), F.lit(float(n_samples)))).drop("xa", "xb")


def _marks(sets: DataFrame) -> DataFrame:
    """node, m (the set's size) and w0, w1 ...: the words of a parity bit sketch of the set's members."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SETS_AT_ONCE):
                batch = whole.slice(at, SETS_AT_ONCE)
                lists = batch.column(1)
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                words = bit_sketches(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(size)), size), len(size), 64 * WORDS, True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(float)), *(pa.array(words[:, k].view(np.int64)) for k in range(WORDS))], names=["node", "m", *(f"w{k}" for k in range(WORDS))])

    hashes = sets.select("node", F.transform("samples", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashes.mapInArrow(kernel, "node bigint, m double, " + ", ".join(f"w{k} bigint" for k in range(WORDS)))


def _near(pairs: DataFrame, marks: DataFrame, n_samples: int, max_dist: float) -> DataFrame:
    """a, b and near (higher: closer) of the pairs whose bit sketches allow a distance below max_dist. marks: a written table.

    The bit sketches differ in at most as many bits as the sets in members, and the distance falls with what two sets share.
    """
    end = lambda c: marks.select(F.col("node").alias(c), F.col("m").alias(f"m{c}"), *(F.col(f"w{k}").alias(f"{c}{k}") for k in range(WORDS)))
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)), F.lit(0))
    shared = F.least("ma", "mb", (F.col("ma") + F.col("mb") - apart) / 2)
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    return both.select("a", "b", (-dual_distance(shared, F.col("ma"), F.col("mb"), F.lit(float(n_samples)))).alias("near")).where(F.col("near") > -max_dist)


def _edges(pairs: DataFrame, sets: DataFrame, n_samples: int, least: int, max_dist: float) -> DataFrame:
    """g, h: the components of the pairs (a, b, g, h; a written table) that are edges by their exact sketches and sets. Only sets of these pairs are sent."""
    few = small(pairs.select("a", "b", "g", "h"))
    left = sets.join(few, F.col("node") == F.col("a")).select("b", "g", "h", F.col("samples").alias("x"), F.col("sketch").alias("sx"))
    ends = pairs.select("b").distinct()
    right = sets.join(F.broadcast(ends) if pairs.count() <= SMALL_ROWS else ends, F.col("node") == F.col("b"), "left_semi").select(F.col("node").alias("b"), F.col("samples").alias("y"), F.col("sketch").alias("sy"))
    size = lambda c: F.size(c).cast("double")
    dist = dual_distance(common("x", "y").cast("double"), size("x"), size("y"), F.lit(float(n_samples)))
    return left.join(right, "b").where((common("sx", "sy") >= least) & (dist < max_dist)).select("g", "h").distinct()


def cluster(has: DataFrame, n_samples: int, key: str = "kmer", sketch: int = SKETCH, min_shared: int = MIN_SHARED, max_dist: float = MAX_DIST, group: str | None = None, hasher=portable_hash) -> DataFrame:
    """key and component (its least key), for every key of has.

    has is read twice: for sketches, and for the sets that may have an edge.
    """
    scratch, groups, least = Scratch(has.sparkSession), [group] if group else [], max(min_shared, 1)
    whole = checked(has, n_samples).select(key, *groups, F.array_sort("samples").alias("samples"))
    able = (F.size("sketch") >= least) & F.lit(max_dist > 0)  # a set that pairs with none, not even with a copy, has no node
    rows = sketches(whole, key, sketch, hasher).select(key, *groups, F.col("samples").alias("value"), F.size("samples").cast("bigint").alias("len"), F.when(able, F.col("sketch")).alias("sketch"))
    keys, nodes, _ = _nodes(rows, key, groups, scratch)
    pairs = meeting_nodes(nodes.select("node", "grp", "sketch"), scratch, least)
    # The distance falls with what two sets share, which is at most the smaller one.
    sizes = small(nodes.select("node", "grp", F.col("len").cast("double").alias("m")))
    sized = pairs.join(sizes.toDF("a", "ga", "ma"), "a").join(sizes.toDF("b", "gb", "mb"), "b").where("ga = gb")
    sized = scratch.cut(sized.where(dual_distance(F.least("ma", "mb"), F.col("ma"), F.col("mb"), F.lit(float(n_samples))) < max_dist).select("a", "b"))
    needed = scratch.cut(sized.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep", "grp"), "node"))
    one = needed.select("node", F.col("rep").alias(key), *(["grp"] if groups else []))
    where = whole.withColumn("grp", F.xxhash64(*groups)) if groups else whole
    own = where.join(small(one) if key_is_long(where, key) else one, [key, *(["grp"] if groups else [])])
    sets = scratch.cut(sketches(own.select("node", "samples"), "node", sketch, hasher))
    rest = _near(sized, scratch.cut(_marks(sets)), n_samples, max_dist)
    rest = scratch.cut(rest.select("a", "b", "near", F.col("a").alias("g"), F.col("b").alias("h")))
    scratch.release(keys, nodes, needed, sets, rest)
    scratch.clean()
    of, turn, left = needed.select("node", F.col("node").alias("component")), 0, rest.count()
    while left:
        crowded = turn < ROUNDS and left > CROWDED * needed.count()
        some = rest
        if crowded:  # each component's best pair only
            ends = rest.select("g", "near", "a", "b", F.col("h").alias("o")).union(rest.select("h", "near", "a", "b", F.col("g").alias("o")))
            best = ends.groupBy("g").agg(F.max(F.struct("near", "a", "b", "o")).alias("best"))
            some = scratch.cut(best.select("best.a", "best.b", F.least("g", "best.o").alias("g"), F.greatest("g", "best.o").alias("h")).distinct())
        links = scratch.cut(_edges(some, sets, n_samples, least, max_dist))
        new = links.count()
        if new:
            onto = scratch.cut(graph.connected_components(links, scratch, new))
            of = scratch.cut(of.join(small(onto.toDF("component", "onto")), "component", "left").select("node", F.coalesce("onto", "component").alias("component")))
        if not crowded:
            break
        apart = rest.select("a", "b", "near").join(some.select("a", "b"), ["a", "b"], "left_anti")
        to = small(of)
        apart = apart.join(to.toDF("a", "g"), "a").join(to.toDF("b", "h"), "b").where("g <> h")
        rest = scratch.cut(apart.select("a", "b", "near", "g", "h"))
        scratch.clean()
        left, turn = rest.count(), turn + 1
    found = keys.join(small(of) if left else of, "node", "left").select(key, F.coalesce("component", "node").alias("c"))
    first = found.where("c is not null").groupBy("c").agg(F.min(key).alias("component"))
    return found.join(first, "c", "left").select(key, F.coalesce("component", key).alias("component"))


def _squares(sets: DataFrame, n_samples: int) -> DataFrame:
    """component, a, far: the sum of a set's squared distances to the others, times their keys. sets: component, samples, a, times; a written table.

    Sets of a component meet in blocks of SETS, each pair of blocks in a place of its own, so each set is sent once for each block.
    """
    blocks = sets.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / SETS).cast("int").alias("blocks"))
    own = sets.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    each = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("own", "i").alias("low"), F.greatest("own", "i").alias("high"), "own", "a", "times", "samples")
    place = ["component", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
            for c in range(3):
                new |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                more = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0] != more.column(c)[0] for c in range(3)):
                    yield distances(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(more)
        if held:
            yield distances(pa.Table.from_batches(held).combine_chunks())

    def distances(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("samples").chunk(0)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        code, row = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        many = np.bincount(code)[code] > 1  # what one set has alone is in no intersection
        code, row = np.unique(code[many], return_inverse=True)[1], row[many]
        both = np.zeros((len(size), len(size)), dtype=np.float64)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            a, b = np.searchsorted(code, [at, at + COLUMNS])
            dense = np.zeros((len(size), COLUMNS), dtype=np.float32)
            dense[row[a:b], code[a:b] - at] = 1
            both += dense @ dense.T
        n, union = float(n_samples), size[:, None] + size[None, :] - both
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where((union == 0) | (n - both == 0), 0.0, 1.0 - 0.5 * (both / union) - 0.5 * ((n - union) / (n - both)))
        own, low, high = (table.column(c).to_numpy() for c in ("own", "low", "high"))
        meet = (own[:, None] != own[None, :]) | (low == high)[:, None]
        np.fill_diagonal(meet, False)
        far = np.where(meet, d * d, 0.0) @ table.column("times").to_numpy().astype(float)
        return pa.RecordBatch.from_arrays([table.column("component").chunk(0), table.column("a").chunk(0), pa.array(far)], names=["component", "a", "far"])

    kinds = dict(sets.dtypes)
    far = each.repartition(*place).sortWithinPartitions(*place).select(*place, "own", "a", "times", "samples").mapInArrow(compare, f"component {kinds['component']}, a {kinds['a']}, far double")
    return far.groupBy("component", "a").agg(F.sum("far").alias("far"))


def medoids(clusters: DataFrame, has: DataFrame, n_samples: int, key: str = "kmer") -> DataFrame:
    """component, size, medoid and rms: the member of least root mean square dual distance to the others.

    A single member is its own medoid, with no rms. Ties go to the least key; largest components first.
    Members with equal sets are at distance 0 and alike to all others, so each set is compared once, with its number of keys.
    """
    scratch = Scratch(has.sparkSession)
    size = scratch.cut(clusters.groupBy("component").agg(F.count("*").alias("size"), F.min(key).alias("only")))
    several = clusters.join(size.where("size > 1").select("component"), "component").select(key, "component")
    several = scratch.cut(several)
    sets = has.select(key, F.array_sort("samples").alias("samples")).join(small(several) if key_is_long(several, key) else several, key)
    sets = scratch.cut(sets.groupBy("component", "samples").agg(F.min(key).alias("a"), F.count("*").alias("times")))
    rms = sets.select("component", "a").join(_squares(sets, n_samples), ["component", "a"], "left").join(size.select("component", "size"), "component")
    rms = rms.select("component", "a", F.sqrt(F.coalesce("far", F.lit(0.0)) / (F.col("size") - 1)).alias("rms"))
    best = rms.groupBy("component").agg(F.min(F.struct(F.round("rms", 12).alias("rms"), "a")).alias("best"))
    out = size.join(best, "component", "left").select("component", "size", F.coalesce("best.a", "only").alias("medoid"), F.col("best.rms").alias("rms"))
    return out.orderBy(F.desc("size"), "component")


def size_quantiles(clusters: DataFrame, n: int = 20) -> DataFrame:
    """n + 1 quantiles of the component sizes, from the largest down."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("times"))
    # Sizes are few, so their repeats are ranked and not listed.
    order = W.orderBy(F.desc("size"))
    ranked = sizes.select("size", F.sum("times").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("times").over(W.partitionBy()).alias("total"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(i.alias("tile"), (F.round(i / F.lit(n) * (F.col("total") - 1)) + 1).alias("place"))))
    first = ranked.withColumn("before", F.col("upto") - F.lag("upto", 1, 0).over(order)).withColumn("low", F.col("upto") - F.col("before"))
    return first.select("size", "low", "upto", at.alias("q")).where("q.place > low and q.place <= upto").select(F.col("q.tile").alias("tile"), "size")


__all__ = ["candidates", "checked", "cluster", "medoids", "ntiles", "pair_distances", "size_quantiles", "sketches"]
