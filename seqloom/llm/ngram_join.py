"""N-gram Jaccard self-join by parity sketches.

A document is its set of distinct five-word shingles (A-Z lower-cased; the whole sequence as one shingle
when it has fewer words). Two sets with Jaccard similarity J >= 0.8 have a symmetric difference of at most
(|S| + |T|) / 9 shingles, and sizes within a factor 1.25.

1. Sketch. Sizes fall into bands. In its band's scheme a set is cut into P parts by hash and every part
   keeps the XOR of its shingles' 64-bit hashes: a sketch of P words of which each shingle touches one, so
   that the number of differing words (their Hamming distance) is a lower bound of the symmetric difference.
2. Pigeonhole. A set whose non-empty parts outnumber its largest possible difference D has at least one
   non-empty part in common with every partner, whatever the partner. Parts are join keys. Very frequent
   shingles are left out first; a set that then has too few non-empty parts also joins by the parts of its
   full set, and, if those are too few, by its single shingles. As a partner that has enough parts is found
   by the level above, no link is lost.
3. Join. Map tasks send packed (key, set) runs by key range, 12 bytes a key, and what belongs to the set once;
   a reducer sorts a range and keeps the keys that different sets share. Keys that a sample shows to be very
   frequent are dealt by set instead, as they are shared for certain. Equal sets are one node.
4. Prune. Partners differ in at most D parts, so the rarest key that they share is among the D + 1 rarest of
   either's keys of that kind; all others go. Sets with more than D keys of their own have no partner.
5. Stars. Each node is first verified against one centre: of its keys' most connected nodes the one it
   shares most keys with. Links found are contracted to components, and what a key has beside its centre's
   component gets a centre of its own in the next round. So a group of thousands of near copies costs a
   few comparisons each, not their square.
6. Verify. Keys that still hold several components are compared in blocks, of keys of the same nodes only one
   (near copies have most of theirs in common): parity bit sketches, in which
   every shingle flips one bit, bound the symmetric difference from below by their Hamming distance, and
   only pairs within the bound of a link leave the block, to be verified with the exact sets: each
   component's closest pair in a block as long as that joins any, and then all pairs that are left. The largest component of a
   key is dealt once for each block of the key's other nodes and never meets itself.

Results: empty texts and texts without words have an empty set and are alone. Texts of one id are linked with
each other, and repeated rows are linked as equal texts are; null ids stay as rows of their own. An empty
table gives no rows. Very long texts are handled whole, one at a time. Other columns than id and text are
never read, so their names can't clash. Shingle hashes have 64 bits; sets whose 64-bit ids agree by chance
are told apart by a second fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import Scratch, flat_bytes, give_back, map_arrow, slices
from .text_kernel import U, mix, shingles

SLICE = 512 << 10
BAND = 1.4
#: Parts of a scheme per shingle of its band's upper end.
PARTS = 0.33
#: Keys that a map task gathers before it sends them, those that a range has on average, and the most that a reducer holds.
FLUSH_KEYS, RANGE_KEYS, HELD_KEYS = 200_000, 400_000, 1_500_000
#: One in so many sets tells what is very frequent: shingles and keys in FREQUENT of them; at most MOST_FREQUENT of each.
SAMPLE, FREQUENT, MOST_FREQUENT = 64, 8, 100_000
#: Bits of a bit sketch, as powers of two, and the rows of one key that a task compares with as many others.
LEAST_BITS, MOST_BITS, BLOCK = 6, 17, 4096
#: Bits for each shingle, at least; and the share of a sketch's words that a first look at a pair takes.
BITS_A_SHINGLE, FIRST_LOOK = 4, 4
#: Rounds of centres, and of closest pairs, before all pairs that are left are verified.
STARS, TURNS = 2, 8
#: A side of at most so many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
#: Stands for the number of nodes of a very frequent key.
HOT = 1 << 30
#: Bits that tell keys of a range apart; three more hold the kind. A chance meeting only costs a comparison.
KEY_BITS = 29
NONE = np.zeros(0, np.uint64)


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(BAND * out[-1]))))
    return np.array(out, dtype=np.int64)


EDGES = _edges()
#: Parts of each band's scheme.
SCHEME = np.maximum(2, np.ceil(PARTS * EDGES[1:] + 2 * np.sqrt(EDGES[1:]) * PARTS)).astype(np.int64)


def set_hashes(value: np.ndarray, row: np.ndarray, rows: int, clashes: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, id and second fingerprint of each row's set; an empty set has id 0. Ids in `clashes` take the fingerprint in."""
    size = np.bincount(row, minlength=rows)
    some = np.flatnonzero(size)
    one, two = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)
    if len(some):
        at = np.cumsum(size)[some] - size[some]
        one[some] = mix(np.add.reduceat(mix(value), at) + size[some].astype(np.uint64))
        two[some] = mix(np.bitwise_xor.reduceat(mix(value ^ U(0x9E3779B97F4A7C15)), at))
        if len(clashes):
            one = np.where(np.isin(one, clashes) & (size > 0), mix(one + mix(two)), one)
    return size, one.view(np.int64), two.view(np.int64)


def part_keys(value: np.ndarray, row: np.ndarray, parts: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of the non-empty parts; values are sorted in their rows, so the parts are stretches of them.

    parts, salt: of each row. A part whose XOR is zero counts as empty.
    """
    if not len(value):
        return value, row
    part = (value >> U(32)) * parts[row].astype(np.uint64) >> U(32)
    first = np.ones(len(value), dtype=bool)
    first[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    word = np.bitwise_xor.reduceat(value, at)
    keep = word != 0
    at = at[keep]
    return mix(word[keep] + mix(salt[row[at]] + part[at] * U(0x9E3779B97F4A7C15))), row[at]


def join_keys(value: np.ndarray, row: np.ndarray, size: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """All keys of the rows: key, row, kind, and the number of keys that the row has of this kind.

    A row has keys at home in the band of its size (kinds 0 to 2, by level), and as the larger of a pair in
    the band below (kinds 3 to 5).
    """
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        rare = frequent[at] != value
    else:
        rare = np.ones(len(value), dtype=bool)
    band = np.searchsorted(EDGES, size, side="right") - 1
    below = (band > 0) & (4 * size < 5 * EDGES[np.maximum(band, 0)])
    out = []
    for first, where, scheme, most in ((0, size > 0, band, size // 4), (3, below, band - 1, 2 * size // 9)):
        scheme = np.where(where, scheme, 0)
        parts = SCHEME[scheme]
        open_ = where.copy()
        for level in range(3):
            take = open_[row] & (rare if level == 0 else True)
            v, r = value[take], row[take]
            salt = mix((scheme * 4 + level).astype(np.uint64) + U(1))
            if level < 2:
                key, owner = part_keys(v, r, parts, salt)
            else:
                key, owner = mix(v + salt[r]), r
            count = np.bincount(owner, minlength=len(size))
            out.append((key, owner, np.full(len(key), first + level), count[owner]))
            open_ &= count <= most
            if not open_.any():
                break
    return tuple(np.concatenate(x) for x in zip(*out))


def bit_sketches(value: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bit sketches: each shingle flips one of m bits, m being the power of two from BITS_A_SHINGLE times the set's size on.

    The Hamming distance of two sketches (the longer folded by XOR) is at most the symmetric difference.
    """
    bits = 1 << np.clip(np.ceil(np.log2(BITS_A_SHINGLE * np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    begin = np.cumsum(bits) - bits
    place = (mix(value + U(7)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64) + begin[row]
    parity = np.bincount(place, minlength=int(bits.sum())).astype(np.uint8) & 1
    flat = np.packbits(parity, bitorder="little").tobytes()
    return [flat[a : a + n] for a, n in zip((begin // 8).tolist(), (bits // 8).tolist())]


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words folded to `width` words."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def close_pairs(node: np.ndarray, size: np.ndarray, group: np.ndarray, side: np.ndarray, sketch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and sketch distance of rows of different groups whose sizes and sketches allow a link, some blocks at a time.

    side: -1 for rows that meet all others, or 0 and 1 for rows that meet the other side only.
    Rows are compared in blocks, those with sketches of one length at a time.
    """
    width = np.array([len(s) // 8 for s in sketch])
    kinds = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    words = {w: np.frombuffer(b"".join(sketch[i] for i in at), dtype="<u8").reshape(len(at), w) for w, at in kinds.items()}
    for w, at in kinds.items():
        for v, other in kinds.items():
            if v < w or v > 2 * w:  # link sizes differ by less than a factor of two
                continue
            mine, theirs = words[w], fold(words[v], w)
            look = max(1, w // FIRST_LOOK)
            few, fewer = fold(mine, look), fold(theirs, look)
            step = max(1, (1 << 20) // max(1, len(other) * look))
            for a in range(0, len(at), step):
                i = at[a : a + step]
                s, t = size[i][:, None], size[other][None, :]
                fit = (group[i][:, None] != group[other][None, :]) & (5 * np.minimum(s, t) >= 4 * np.maximum(s, t))
                fit &= (side[i][:, None] < 0) | (side[i][:, None] != side[other][None, :])
                if v == w:
                    fit &= node[i][:, None] < node[other][None, :]
                x, y = np.nonzero(fit)
                most = (size[i][x] + size[other][y]) // 9
                close = np.bitwise_count(few[a + x] ^ fewer[y]).sum(axis=1, dtype=np.int64) <= most
                x, y, most = x[close], y[close], most[close]
                for k in range(0, len(x), 1 + (1 << 20) // w):
                    p, q = x[k : k + 1 + (1 << 20) // w], y[k : k + 1 + (1 << 20) // w]
                    far = np.bitwise_count(mine[a + p] ^ theirs[q]).sum(axis=1, dtype=np.int64)
                    good = far <= most[k : k + len(p)]
                    if good.any():
                        yield i[p[good]], other[q[good]], far[good]


def closest(group: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs those that are the closest one of either group."""
    keep = np.zeros(len(i), dtype=bool)
    for end in (i, j):
        order = np.lexsort((far, group[end]))
        first = np.ones(len(order), dtype=bool)
        first[1:] = group[end][order][1:] != group[end][order][:-1]
        keep[order[first]] = True
    return i[keep], j[keep], far[keep]


def node_table(docs: DataFrame, clashes: np.ndarray = NONE) -> DataFrame:
    """doc_id, version, n_shingles, node (id of the set; 0 when empty), second fingerprint, and the shingles of one set in SAMPLE.

    docs: doc_id, text and version (a hash of the text).
    """
    kind = dict(docs.dtypes)["doc_id"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, row = shingles(*flat_bytes(batch.column(2)))
        size, one, two = set_hashes(value, row, batch.num_rows, clashes)
        ends = np.cumsum(size)
        picked = (one.view(np.uint64) % U(SAMPLE) == 0) & (size > 0)
        sample = [value[b - n : b].view(np.int64).tolist() if p else None for b, n, p in zip(ends, size, picked)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(one), pa.array(two), pa.array(sample, pa.list_(pa.int64()))],
            names=["doc_id", "version", "n_shingles", "node", "twin", "sample"],
        )

    return map_arrow(docs.select("doc_id", "version", "text"), kernel, f"doc_id {kind}, version long, n_shingles long, node long, twin long, sample array<long>", "text", SLICE)


def _most_frequent(values: DataFrame) -> np.ndarray:
    """Sorted 64-bit values (column v) that occur FREQUENT times: at most MOST_FREQUENT."""
    top = values.groupBy("v").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "v").limit(MOST_FREQUENT)
    return np.sort(np.array([r.v for r in top.select("v").collect()], dtype=np.int64).view(np.uint64))


def frequent_shingles_and_keys(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of very frequent shingles, and very frequent keys, by the sampled sets. They steer the work; no result depends on them."""
    each = nodes.where("sample is not null").groupBy("node").agg(F.first("sample").alias("sample"))
    frequent = _most_frequent(each.select(F.explode("sample").alias("v")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0):
                value = s.values.to_numpy().view(np.uint64)
                key = join_keys(value, np.zeros(len(value), np.int64), np.array([len(value)]), frequent)[0]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["v"])

    return frequent, _most_frequent(each.select("sample").mapInArrow(give_back(keys), "v long"))


NAMES = ["key", "node", "kind", "many", "size", "parts"]


def shared_keys(docs: DataFrame, frequent: np.ndarray, hot: np.ndarray, bits: int, clashes: np.ndarray = NONE) -> DataFrame:
    """key, node, kind, many: the keys that several nodes have, with the number of these nodes; and node, kind, size, parts, without key.

    parts is the number of keys of that kind that the node has: two sets whose difference is at most D
    share all but D of the parts of either. Very frequent keys have HOT for many, and may come repeatedly,
    as rows without key may.
    """

    def pack(held: tuple[list, ...], sets: tuple[list, ...]) -> pa.RecordBatch:
        bucket, low, node = (np.concatenate(x) for x in held)
        order = np.argsort(bucket, kind="stable")
        bucket, low, node = bucket[order], low[order], node[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        edges = [0, *cuts.tolist(), len(bucket)]
        runs = [low[a:b].tobytes() + node[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        # What belongs to the sets is one run, in the negative of a range that its first set gives.
        whose, kind, size, parts = (np.concatenate(x) for x in sets)
        to = -1 - int(mix(whose[:1].view(np.uint64))[0] >> U(64 - bits))
        runs.append(whose.tobytes() + size.astype("<u4").tobytes() + parts.astype("<u4").tobytes() + kind.astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.append(bucket[edges[:-1]], to), pa.int32()), pa.array(runs, pa.binary())], names=["bucket", "run"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [])
        sets: tuple[list, ...] = ([], [], [], [])
        count, seen = 0, np.zeros(0, np.int64)
        for batch in slices(batches, "text", SLICE):
            value, row = shingles(*flat_bytes(batch.column(0)))
            size, node, _ = set_hashes(value, row, batch.num_rows, clashes)
            # Equal sets send their keys once.
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= ~np.isin(node, seen) & (size > 0)
            seen = np.union1d(seen, node)
            keep = fresh[row]
            key, owner, kind, _ = join_keys(value[keep], row[keep], np.where(fresh, size, 0), frequent)
            bucket = (key >> U(64 - bits)).astype(np.int64)
            low = (key << U(bits)) >> U(64 - KEY_BITS)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                often = hot[at] == key
                bucket[often] = (1 << bits) | (mix(node[owner[often]].view(np.uint64)) >> U(64 - bits)).astype(np.int64)
                low[often] = at[often]
            low = low.astype("<u4") << np.uint32(3) | kind.astype(np.uint32)
            # Keys of one set that are equal as they are sent are one.
            whole = bucket.astype(np.uint64) << U(32) | low
            if len(np.unique(mix(whole) + mix(owner.astype(np.uint64) + U(1)))) < len(whole):
                once = np.unique(np.stack([owner.astype(np.uint64), whole]), axis=1, return_index=True)[1]
                bucket, low, owner, kind = bucket[once], low[once], owner[once], kind[once]
            parts = np.bincount(owner * 6 + kind, minlength=6 * batch.num_rows)
            there = np.flatnonzero(parts)
            for part, x in zip(held, (bucket, low, node[owner])):
                part.append(x)
            for part, x in zip(sets, (node[there // 6], there % 6, size[there // 6], parts[there])):
                part.append(x)
            count += len(low)
            if count >= FLUSH_KEYS:
                yield pack(held, sets)
                held, sets, count, seen = ([], [], []), ([], [], [], []), 0, np.zeros(0, np.int64)
        if count:
            yield pack(held, sets)

    def out(bucket: int, key: np.ndarray, node: np.ndarray, kind: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        whole = -1 - key if bucket >> bits else np.int64(bucket) << KEY_BITS | key
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(whole), pa.array(node), pa.array(kind), pa.array(many.astype(np.int32)), none, none], names=NAMES)

    def sets_of(run: bytes) -> pa.RecordBatch:
        n = len(run) // 17
        size, parts = (np.frombuffer(run, "<u4", n, at * n).astype(np.int64) for at in (8, 12))
        kind = np.frombuffer(run, np.uint8, n, 16 * n).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.frombuffer(run, "<i8", n)), pa.array(kind), pa.nulls(n, pa.int32()), pa.array(size), pa.array(parts)], names=NAMES)

    def opened(run: bytes) -> tuple[np.ndarray, ...]:
        n = len(run) // 12
        low = np.frombuffer(run, "<u4", n)
        return (low >> np.uint32(3)).astype(np.int64), np.frombuffer(run, "<i8", n, 4 * n), (low & np.uint32(7)).astype(np.int32)

    def meet(bucket: int, held: list[tuple[np.ndarray, ...]], free: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, list[tuple[np.ndarray, ...]], np.ndarray]:
        """Rows of shared keys, the rows that wait for a partner, and the keys known to be shared (`free`), which no longer wait.

        Only a range that outgrows HELD_KEYS is met before its last row; what it holds then is a row a key.
        """
        columns = [np.concatenate(x) for x in zip(*held)]
        key = columns[0]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        shared = np.isin(key[order], free) if len(free) or bucket >> bits else np.zeros(len(key), dtype=bool)
        shared |= bool(bucket >> bits)
        several = order[same[1:] | same[:-1] | shared]
        alone = [] if last else order[~(same[1:] | same[:-1] | shared)]
        key, node, kind = (c[several] for c in columns)
        order = np.lexsort((kind, node, key))
        key, node, kind = key[order], node[order], kind[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])
        key, node, kind = key[new], node[new], kind[new]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        length = np.diff(np.append(np.flatnonzero(first), len(key)))
        many = np.repeat(length, length)
        known = np.isin(key, free) | bool(bucket >> bits)
        if not last:
            wait = ~known & (many == 1)  # one set that was sent several times
            alone = [np.concatenate([c[alone], x[wait]]) for c, x in zip(columns, (key, node, kind))]
            many[:] = HOT
            key, node, kind, many = (x[~wait] for x in (key, node, kind, many))
            free = free if bucket >> bits else np.union1d(free, key)
        else:
            keep = known | (many > 1)
            many = np.where(known, HOT, many)
            key, node, kind, many = (x[keep] for x in (key, node, kind, many))
        return out(bucket, key, node, kind, many) if len(key) else None, [] if last or not len(alone[0]) else [tuple(alone)], free

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now, count, free = -1, 0, np.zeros(0, np.int64)
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket < 0:
                    yield sets_of(batch.column(1)[i].as_py())
                    continue
                if bucket != now:
                    if held and (found := meet(now, held, free, True)[0]) is not None:
                        yield found
                    now, held, count, free = bucket, [], 0, np.zeros(0, np.int64)
                held.append(opened(batch.column(1)[i].as_py()))
                count += len(held[-1][0])
                if count >= HELD_KEYS:
                    found, held, free = meet(now, held, free, False)
                    count = sum(len(h[0]) for h in held) // 2
                    if found is not None:
                        yield found
        if held and (found := meet(now, held, free, True)[0]) is not None:
            yield found

    sent = docs.select("text").where("text is not null").mapInArrow(give_back(send), "bucket int, run binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(give_back(receive), "key long, node long, kind int, many int, size long, parts long")


def prune(keyed: DataFrame) -> DataFrame:
    """key, node, size, weight (the node's shared keys of the kind): its D + 1 rarest keys of a kind, those that no other node has (which aren't listed) counted first."""
    keys = keyed.select("key", "node", "kind", "many")
    each = keys.where(F.col("many") < HOT).union(keys.where(F.col("many") == HOT).distinct())
    each = each.join(keyed.where("key is null").select("node", "kind", "size", "parts").distinct(), ["node", "kind"])
    kind = W.partitionBy("node", "kind")
    most = F.when(F.col("kind") < 3, F.floor(F.col("size") / 4)).otherwise(F.floor(2 * F.col("size") / 9))
    rank, shared = F.row_number().over(kind.orderBy("many", "key")), F.count("*").over(kind)
    ranked = each.withColumns({"weight": shared, "rank": rank})
    return ranked.where(F.col("rank") + F.col("parts") - F.col("weight") <= most + 1).select("key", "node", "size", "weight")


def small(df: DataFrame) -> DataFrame:
    """df (a written table) marked for broadcast when it has at most BROADCAST_BYTES: 16 for each column and row, and the length of strings; else as it is."""
    texts = [F.length(c) for c, t in df.dtypes if t not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")]
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        return df
    size = F.coalesce(F.sum(sum(texts, F.lit(16 * len(df.columns))).cast("long")), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_BYTES else df


def shingle_sets(docs: DataFrame, needed: DataFrame, clashes: np.ndarray = NONE) -> DataFrame:
    """node, shingles (array of hashes) and bit sketch of the needed nodes (node, doc_id, version of one text that has it). Only those texts are hashed again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a repeated row is hashed, but goes on once per task
        for batch in slices(batches, "text", SLICE):
            value, row = shingles(*flat_bytes(batch.column(1)))
            size, node, _ = set_hashes(value, row, batch.num_rows, clashes)
            right = node == batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(right).tolist():
                right[i] = node[i] not in done
                done.add(node[i])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(value.view(np.int64)))
            sketch = pa.array(bit_sketches(value, row, size), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, sketch], names=["node", "shingles", "sketch"]).filter(pa.array(right))

    on = docs["doc_id"].eqNullSafe(needed["doc_id"]) & (docs["version"] == needed["version"])
    return docs.join(small(needed), on).select(needed["node"], "text").mapInArrow(give_back(sets), "node long, shingles array<long>, sketch binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; a written table) of nodes whose exact sets have 100 * |intersection| >= 80 * |union|.

    Few pairs go to the sets, so that only sets of pairs are dealt: each set of `a` with its pair, each set of `b` once.
    """
    sets, pairs = sets.select("node", "shingles"), pairs.select("a", "b").distinct()
    few = small(pairs)
    left = sets.join(few, F.col("node") == F.col("a")).select("a", "b", F.col("shingles").alias("x"))
    right = sets.join(small(pairs.select(F.col("b").alias("n")).distinct()), F.col("node") == F.col("n"), "left_semi").toDF("b", "y")
    size = lambda c: F.size(c).cast("long")
    both = left.join(right, "b").withColumn("common", size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= 80 * (size("x") + size("y") - F.col("common"))).select("a", "b").distinct()


def crossing_pairs(held: DataFrame, groups: DataFrame, sets: DataFrame, scratch: Scratch, every: bool) -> tuple[DataFrame, DataFrame]:
    """a, b (nodes that share a key, but no component, and may be linked), their components g and h, and `more`; and the rows of keys of several components.

    Without `every`, a place of more pairs than rows gives each component's closest pair only, and `more` tells that there were others.

    The nodes of a key meet in blocks of BLOCK rows, each pair of blocks in a place of its own, so that a key
    of any size is spread. Rows of its largest component meet the others only. Only pairs that pass the
    bounds of sizes and bit sketches leave the block. Keys of the same nodes (by their number and the sums of
    both halves of their hashes) would give the same pairs: the least of them stands for all.
    """
    known = held.join(small(groups), "node").select("key", "node", "size", F.col("component").alias("group"))
    upper, lower = F.shiftrightunsigned(F.xxhash64("node"), 32), F.xxhash64("node").bitwiseAND(F.lit((1 << 32) - 1))
    rows = known.groupBy("key", "group").agg(F.count("*").alias("rows"), F.sum(upper).alias("upper"), F.sum(lower).alias("lower"))
    sums = [F.sum(c).alias(n) for c, n in (("rows", "all"), ("upper", "upper"), ("lower", "lower"))]
    per = rows.groupBy("key").agg(F.max(F.struct("rows", "group")).alias("top"), *sums, F.count("*").alias("groups")).where("groups > 1")
    per = per.groupBy("all", "upper", "lower").agg(F.min(F.struct("key", "top")).alias("one")).select("one.key", "one.top", "all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    mixed = scratch.cut(per.select("key", F.col("top.group").alias("base"), blocks(F.col("top.rows")).alias("base_blocks"), blocks(F.col("all") - F.col("top.rows")).alias("blocks")), held.count())
    several = known.join(small(mixed), "key")
    rest = several.join(sets.select("node", "sketch"), "node")
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    place = lambda what, a, b, side: F.struct(F.xxhash64("key", F.lit(what), a, b).alias("place"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    is_base = F.col("group") == F.col("base")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.when(is_base, F.col("base_blocks")).otherwise(F.col("blocks"))))
    own = F.col("own")
    side = lambda i: F.when(own == i, -1).when(own < i, 0).otherwise(1)
    as_base = each(F.col("blocks"), lambda i: place(0, own, i, 0))
    as_other = F.concat(each(F.col("base_blocks"), lambda i: place(0, i, own, 1)), each(F.col("blocks"), lambda i: place(1, F.least(own, i), F.greatest(own, i), side(i))))
    dealt = rest.withColumn("to", F.explode(F.when(is_base, as_base).otherwise(as_other))).select("to.place", "node", "size", "group", "to.side", "sketch").repartition("place").sortWithinPartitions("place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []
        for batch in batches:
            here = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(here)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                more = batch.slice(a, b - a)
                if part and part[0].column(0)[0] != more.column(0)[0]:
                    yield from pairs_of(part)
                    part = []
                part.append(more)
        if part:
            yield from pairs_of(part)

    def pairs_of(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(part)
        node, size, group, side = (table.column(c).to_numpy() for c in ("node", "size", "group", "side"))
        found = close_pairs(node, size, group, side, table.column("sketch").to_pylist())
        if every:
            for i, j, _ in found:
                yield rows_of(node, group, i, j, False)
            return
        best, total = (np.zeros(0, np.int64),) * 3, 0
        for some in found:
            total += len(some[0])
            best = tuple(np.concatenate(x) for x in zip(best, some))
            if total > len(node):
                best = closest(group, *best)
        if total:
            yield rows_of(node, group, best[0], best[1], total > len(best[0]))

    def rows_of(node: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray, more: bool) -> pa.RecordBatch:
        columns = [np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.minimum(group[i], group[j]), np.maximum(group[i], group[j]), np.full(len(i), more)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "g", "h", "more"])

    pairs = dealt.mapInArrow(give_back(compare), "a long, b long, g long, h long, more boolean").groupBy("a", "b", "g", "h").agg(F.max("more").alias("more"))
    return scratch.cut(pairs), scratch.cut(several.select("key", "node", "size"), held.count())


def link_groups(docs: DataFrame, scratch: Scratch, same_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of the rows (node_table), and node and component of all nodes that a link or, with same_id, a document joins to others.

    docs: doc_id, text, version. With same_id rows without id link with nothing, and texts of one id are linked.
    """
    clashes = NONE
    while True:
        nodes = scratch.cut(node_table(docs, clashes))
        rows = nodes.count()
        linked = nodes.where("node <> 0 and doc_id is not null" if same_id else "node <> 0")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
        places = scratch.cut(linked.groupBy("node").agg(first, F.min("twin").alias("low"), F.max("twin").alias("high")).select("node", "first.doc_id", "first.version", "low", "high"), rows)
        # Chance equals among 64-bit ids: a handful, if any, for any corpus.
        found = np.array([r.node for r in places.where("low <> high").select("node").collect()], dtype=np.int64).view(np.uint64)
        if not len(found):
            break
        clashes = np.union1d(clashes, found)
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, 0.6 * total / RANGE_KEYS))), 4, 23))
    frequent, hot = frequent_shingles_and_keys(nodes)
    source = docs.where("doc_id is not null") if same_id else docs
    keyed = scratch.cut(shared_keys(source, frequent, hot, bits, clashes))
    scratch.clean()
    pruned = scratch.cut(prune(keyed), keyed.count())
    rows = pruned.count()
    rest, groups, sets = pruned, None, None

    def contracted(groups: DataFrame, links: DataFrame, rows: int) -> DataFrame:
        """groups after links (g, h) between components."""
        joined = scratch.cut(connected_components(links, scratch, rows), 2 * rows)
        return scratch.cut(groups.join(joined.toDF("component", "onto"), "component", "left").select("node", F.coalesce("onto", "component").alias("component")), groups.count())

    for star in range(STARS):
        # The centre of a key is its node with most shared keys. Keys that no other node has are left behind.
        lead = F.max(F.struct("weight", "node"))
        centres = scratch.cut(rest.groupBy("key").agg(lead.alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.node").alias("lead")), rows)
        rest = scratch.cut(rest.join(small(centres), "key"), rows)
        if groups is None:
            held = rest
            needed = scratch.cut(held.select("node").distinct().join(places.select("node", "doc_id", "version"), "node"), rows)
            sets, count = scratch.cut(shingle_sets(source, needed, clashes)), needed.count()
            if sets.count() > count:  # rows repeated over several tasks
                sets = scratch.cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")))
            groups = scratch.cut(needed.select("node", F.col("node").alias("component")), count)
            if same_id:
                several = scratch.cut(linked.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("doc_id", "least"), nodes.count())
                own = scratch.cut(linked.select("doc_id", "node").join(several, "doc_id").where("node <> least").select("node", "least").distinct(), nodes.count())
                if own.head(1):
                    every = groups.select("node").union(own.select("node")).union(own.select("least")).distinct()
                    groups = contracted(scratch.cut(every.select("node", F.col("node").alias("component")), count + 2 * own.count()), own, own.count())
        of = small(groups)
        between = lambda df: df.join(of.toDF("node", "g"), "node").join(of.toDF("lead", "h"), "lead").where("g <> h")  # noqa: B023, E731
        shared = between(rest).groupBy("node", "lead", "g", "h").agg(F.count("*").alias("shared"))
        best = F.max(F.struct("shared", "lead", "g", "h")).alias("best")
        stars = scratch.cut(shared.groupBy("node").agg(best).select(F.col("node").alias("a"), F.col("best.lead").alias("b"), "best.g", "best.h"), count)
        links = scratch.cut(verify(stars, sets).join(stars, ["a", "b"]).select("g", "h").distinct(), count)
        new = links.count()
        if not new:
            break
        groups = contracted(groups, links, new)
        of = small(groups)
        rest = scratch.cut(between(rest).select("key", "node", "size", "weight"), rows)
        rows = rest.count()
        if not rows:
            break
    every = False
    for turn in range(TURNS):
        # First each component's closest pairs, which may settle the others; at last all that are left.
        every |= turn == TURNS - 1
        pairs, held = crossing_pairs(held, groups, sets, scratch, every)
        rows = pairs.count()
        if not rows:
            break
        links = scratch.cut(verify(pairs, sets).join(pairs, ["a", "b"]).select("g", "h").distinct(), rows)
        new = links.count()
        if new:
            groups = contracted(groups, links, new)
        if every or not pairs.where("more").head(1):
            break
        every = not new
    scratch.release(nodes, groups)
    return nodes, groups


def _versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("version"))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (xxhash64 of the text) and group for every row: rows whose texts are linked have one group; empty sets have none.

    Texts alone decide: those of one id aren't linked for it, and rows without id take part.
    """
    scratch = Scratch(docs.sparkSession)
    nodes, groups = link_groups(_versioned(docs, id_col, text_col), scratch)
    group = F.when(F.col("node") != 0, F.coalesce("component", "node"))
    return nodes.join(groups, "node", "left").select("doc_id", "version", group.alias("group"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    nodes, groups = link_groups(_versioned(docs, id_col, text_col), scratch, same_id=True)
    own, rows = nodes.where("node <> 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least")), nodes.count()
    own = scratch.cut(own.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group")), rows)
    least = scratch.cut(own.groupBy("group").agg(F.min("least").alias("component_id")), rows)
    reach = scratch.cut(own.join(least, "group").select("node", "component_id"), rows)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = nodes.join(reach, "node", "left").select("doc_id", "n_shingles", found.alias("component_id"), "node")
    # A document may have an empty text beside others.
    both = out.groupBy("doc_id").agg(F.min(F.col("node") == 0).alias("all_empty"), F.max(F.col("node") == 0).alias("an_empty"), F.min("component_id").alias("id"))
    both = scratch.cut(both.where("an_empty and not all_empty and doc_id is not null").select(F.col("doc_id").alias("d"), "id"), rows)
    if both.head(1):
        out = out.join(small(both), F.col("doc_id") == F.col("d"), "left").withColumn("component_id", F.coalesce("id", "component_id"))
    scratch.release(nodes, reach, both)
    return out.select("doc_id", "n_shingles", "component_id")


#: The same rows in DuckDB, by the pairs that share shingles.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM w, LATERAL unnest(range(1, greatest(len(l) - 3, least(len(l), 1) + 1))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) m ON m.v = d.doc_id"""
