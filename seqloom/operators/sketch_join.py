"""Pairs of nodes whose sketches share enough hashes, without a shuffled sketch for every pair that meets.

1. Prefix. Sketches of m and n hashes that share s have one of each one's m - s + 1 (n - s + 1) first hashes in
   common, in any order of all hashes. The order is by frequency in a bounded sample, so that very common hashes
   come last; it steers the work, and no result depends on it.
2. Meeting. A node goes to each of its first hashes with a parity bit sketch (every hash flips one bit) of 32 bytes
   for 50 hashes. The Hamming distance of two of them is at most the symmetric difference of the sketches, so only
   pairs that pass this bound leave the task. Nodes of a hash are dealt in blocks of BLOCK, a pair of blocks to a place.
3. Check. The pairs left are compared by their exact sketches.

If the bound is relative, a sketch below it must be contained in its partner's: it goes to its first hash with its
hashes' bits, and others go to those of their hashes that a filter of fixed size has for such ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import common
from ..scratch import Scratch

#: Nodes of a hash that meet in one task; pairs that are looked at together.
BLOCK, AT_ONCE = 2048, 1 << 20
#: Nodes whose hashes are counted for the order, and the most hashes that are kept of them.
SAMPLED, MOST_COMMON = 20_000, 100_000
#: Bits of a bit sketch for each hash, at least; and the logarithm of the filter's bits (8 MB).
BITS_A_HASH, FILTER_BITS = 5, 26
#: Rows of a few numbers that are broadcast at most (some 32 MB).
SMALL_ROWS = 1_000_000
U = np.uint64


def small(df: DataFrame) -> DataFrame:
    """df (a written table of a few numbers a row) marked for broadcast when it has at most SMALL_ROWS."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def bit_sketches(value: np.ndarray, row: np.ndarray, rows: int, bits: int, parity: bool) -> np.ndarray:
    """Rows of 64-bit words: each value flips one of the row's bits, or sets it without `parity`."""
    count = np.bincount(row * bits + (mix(value) & U(bits - 1)).astype(np.int64), minlength=rows * bits)
    return np.packbits((count & 1 if parity else count > 0).astype(np.uint8), bitorder="little").view("<u8").reshape(rows, -1)


def spans(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and the rows first[i] to last[i] (exclusive) that they meet, some AT_ONCE pairs at a time."""
    many = np.maximum(last - first, 0)
    group = np.cumsum(many) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(many)]
    for a, b in zip(edges, edges[1:]):
        n = many[a:b]
        i = np.repeat(np.arange(a, b), n)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[a:b], n)


def binary(words: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values."""
    ends = (np.arange(len(words) + 1) * words.shape[1] * 8).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words).tobytes())])


def _order(nodes: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that the sample has twice or more, and their numbers."""
    own = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, count // SAMPLED))) == 0)
    top = own.select(F.explode("sketch").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "count"))
    order = np.argsort(h)
    return h[order], n[order]


def _unpacked(batch: pa.RecordBatch, order: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Hash, row, rank in the row by the order of all hashes; and the rows' lengths. A hash is salted by its group."""
    lists = batch.column(2)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    value, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length)
    common_, often = order
    f = np.zeros(len(value), np.int64)
    if len(common_):
        at = np.minimum(np.searchsorted(common_, value), len(common_) - 1)
        f = np.where(common_[at] == value, often[at], 0)
    by = np.lexsort((value, f, row))
    rank = np.empty(len(value), np.int64)
    rank[by] = np.arange(len(value)) - np.repeat(np.cumsum(length) - length, length)
    salted = mix(value.view(U) + mix(batch.column(1).to_numpy().view(U))[row])
    return salted, row, rank, length


def _meetings(rows, hot: dict[tuple[int, int], np.ndarray], cross: bool) -> tuple[np.ndarray, ...]:
    """Place, side and index of the rows (place, side, node), those of very common places dealt in blocks.

    hot: sorted places and their numbers of blocks, for the sides 0 and 1 if `cross`, else for all rows.
    """
    place, side, node = rows

    def blocks(which: int) -> np.ndarray:
        where, n = hot[which]
        if not len(where):
            return np.ones(len(place), np.int64)
        at = np.minimum(np.searchsorted(where, place), len(where) - 1)
        return np.where(where[at] == place, n[at], 1)

    mine, theirs = (np.where(side == 0, blocks(0), blocks(1)), np.where(side == 0, blocks(1), blocks(0))) if cross else (blocks(0),) * 2
    own = (mix(node.view(U) ^ place.view(U)) % mine.astype(U)).astype(np.int64)
    at = np.repeat(np.arange(len(place)), theirs)
    other = np.arange(len(at)) - np.repeat(np.cumsum(theirs) - theirs, theirs)
    own, where, s = own[at], place[at].view(U), side[at]
    if cross:
        low, high, side = np.where(s == 0, own, other), np.where(s == 0, other, own), s
    else:
        low, high, side = np.minimum(own, other), np.maximum(own, other), np.where(own == other, -1, (own > other).astype(np.int64))
    spread = (mine * theirs)[at] > 1
    where = np.where(spread, mix(where + mix((low << 32 | high).astype(U) + U(1))), where)
    return where.view(np.int64), side, at


def _met(nodes: DataFrame, order: tuple[np.ndarray, np.ndarray], size: int, min_shared: int, contained: bool) -> DataFrame:
    """a, b: distinct pairs of nodes that pass the bounds; if `contained`, a has less than min_shared hashes, and b more than a."""
    bits = 1 << max(6, int(np.ceil(np.log2(BITS_A_HASH * max(size, 1)))))
    mask = np.zeros(1 << FILTER_BITS >> 3 if contained else 1, np.uint8)
    if contained:

        def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(0, U)
            for batch in batches:
                if batch.num_rows:
                    salted, row, rank, length = _unpacked(batch, order)
                    got = np.union1d(got, salted[(rank == 0) & (length < min_shared)[row]] >> U(64 - FILTER_BITS))
            yield pa.RecordBatch.from_arrays([pa.array([got.astype("<u4").tobytes()], pa.binary())], names=["places"])

        for some in nodes.select("node", "grp", "sketch").mapInArrow(firsts, "places binary").toArrow().column("places"):
            at = np.frombuffer(some.as_py(), "<u4").astype(np.int64)
            np.bitwise_or.at(mask, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        salted, row, rank, length = _unpacked(batch, order)
        if contained:
            key = (salted >> U(64 - FILTER_BITS)).astype(np.int64)
            own, theirs = (rank == 0) & (length < min_shared)[row], (mask[key >> 3] >> (key & 7) & 1).astype(bool)
            take = np.concatenate([np.flatnonzero(own), np.flatnonzero(theirs)])
            side = np.repeat([0, 1], [own.sum(), theirs.sum()])
        else:
            take = np.flatnonzero((rank <= length[row] - min_shared) & (length >= min_shared)[row])
            side = np.zeros(len(take), np.int64)
        node = batch.column(0).to_numpy()
        return salted[take].view(np.int64), side, node[row[take]], row[take], length, salted, row

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, side, *_ = rows_of(batch)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(side.astype(np.int32))], names=["place", "side"])

    wanted = nodes.select("node", "grp", "sketch")
    # At most one place for each BLOCK rows, so few.
    many = wanted.mapInArrow(places, "place long, side int").groupBy("place", "side").count().where(F.col("count") > BLOCK).orderBy("place", "side").toArrow()
    p, s, n = (many.column(c).to_numpy() for c in ("place", "side", "count"))
    hot = {which: (p[s == which], -(-n[s == which] // BLOCK)) for which in (0, 1)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, side, node, at, length, salted, row = rows_of(batch)
                words = bit_sketches(salted, row, batch.num_rows, bits, not contained)
                place, side, k = _meetings((place, side, node), hot, contained)
                columns = [pa.array(place), pa.array(side.astype(np.int32)), pa.array(node[k]), pa.array(length[at[k]].astype(np.int32)), binary(words[at[k]])]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "side", "node", "length", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            cut = int(np.searchsorted(place, place[-1]))  # places are sorted; the last may go on
            if held and cut == 0 and held[-1].column(0)[0].as_py() == place[0]:
                held.append(batch)
                continue
            if cut:
                held.append(batch.slice(0, cut))
            if held:
                yield from pairs_of(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place, side, node, length = (table.column(c).to_numpy() for c in ("place", "side", "node", "length"))
        length = length.astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=~place[:1]))
        size_ = np.diff(np.append(first, len(place)))
        begin, end = np.repeat(first, size_), np.repeat(first + size_, size_)
        if (size_ < 2).all():
            return
        words = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(place), -1)
        # Of a place's rows those of side 0 stand first, and meet those of side 1 only; rows of side -1 meet all that follow.
        ones = np.repeat(np.add.reduceat((side == 1).astype(np.int64), first), size_)
        start = np.where(side < 0, np.arange(len(place)) + 1, np.where(side == 0, end - ones, end))
        for i, j in spans(start, end):
            if contained:
                good = (length[i] < length[j]) & ((words[i] & ~words[j]) == 0).all(axis=1)
                a, b = node[i[good]], node[j[good]]
            else:
                good = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= length[i] + length[j] - 2 * min_shared
                a, b = np.minimum(node[i[good]], node[j[good]]), np.maximum(node[i[good]], node[j[good]])
            a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = wanted.mapInArrow(deal, "place long, side int, node long, length int, bits binary").repartition("place").sortWithinPartitions("place", "side")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def meeting_nodes(nodes: DataFrame, scratch: Scratch, min_shared: int, relative: bool = False) -> DataFrame:
    """a, b: the pairs of `similar_nodes`, and some that aren't, or are of two groups. Each pair once; a written table."""
    count, size = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("sketch")), F.lit(1))).first()
    order = _order(nodes, count)
    pairs = _met(nodes, order, size, min_shared, False)
    if relative:
        pairs = pairs.union(_met(nodes, order, size, min_shared, True))
    pairs = scratch.cut(pairs)
    scratch.clean()
    return pairs


def similar_nodes(nodes: DataFrame, scratch: Scratch, min_shared: int, relative: bool = False) -> DataFrame:
    """a, b, shared: pairs of nodes of one group whose sketches share min_shared hashes, or with `relative` all of the smaller sketch if it has less. Each pair once.

    nodes (a written table): node, grp and sketch (distinct hashes), one row each; no two nodes of a group have the same sketch below min_shared.
    """
    pairs = meeting_nodes(nodes, scratch, min_shared, relative)
    # Only sketches of nodes that met are sent.
    ends = lambda c: small(scratch.cut(pairs.select(F.col(c).alias("node")).distinct()))
    sk = lambda c: nodes.select("node", "grp", "sketch").join(ends(c), "node", "left_semi")
    both = pairs.join(sk("a").toDF("a", "ga", "sa"), "a").join(sk("b").toDF("b", "gb", "sb"), "b").where("ga = gb").withColumn("shared", common("sa", "sb").cast("bigint"))
    bound = F.least(F.lit(min_shared), F.size("sa"), F.size("sb")) if relative else F.lit(min_shared)
    found = scratch.cut(both.where(F.col("shared") >= bound).select("a", "b", "shared"))
    scratch.clean()
    return found
