"""Windows of DNA as packed integers, made for whole Arrow batches.

A word of k bases (31 at most) is a 64-bit integer of two bits a base; numeric order is lexicographic order.
Words of doubling length are put together, so a window costs some ten array operations and no string.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LONGEST = 31
#: Bases that one call handles, about; a longer sequence goes alone.
SLICE = 1 << 18
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def words(code: np.ndarray, k: int, backward: bool = False) -> np.ndarray:
    """The packed word of k codes from each place on; `backward` packs the last code first."""
    out, size, at = None, 0, 0
    part, length = code.astype(np.int64), 1
    while length <= k:
        if k & length:
            if out is None:
                out, size = part, length
            else:
                n = len(part) - size
                a, b = out[: max(n, 0)], part[size:]
                out = a | b << 2 * size if backward else a << 2 * length | b
                size += length
        n = max(len(part) - length, 0)
        a, b = part[:n], part[length:]
        part = a | b << 2 * length if backward else a << 2 * length | b
        length *= 2
    return out[: max(len(code) - k + 1, 0)]


def windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, word and reverse complement of each window without other letters than A, C, G and T."""
    code = _CODE[data]
    fits = np.maximum(np.diff(offsets) - (k - 1), 0)
    row = np.repeat(np.arange(len(fits)), fits)
    place = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits)
    at = place + np.repeat(offsets[:-1], fits)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    good = bad[at + k] == bad[at]
    row, place, at = row[good], place[good], at[good]
    if not len(at):
        return row, place, at, at
    return row, place, words(code & 3, k)[at], words(3 - (code & 3), k, backward=True)[at]


def letter_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of about SLICE letters, with the letters and offsets of a string column."""
    for whole in batches:
        size = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE)) + 1
        edges = [0, *cuts.tolist(), whole.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                batch = whole.slice(a, b - a)
                text = pc.fill_null(batch.column(column).cast(pa.binary()), b"")
                offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
                yield batch, data, offsets - offsets[0]


def packed_windows(reads: DataFrame, k: int, carry: Sequence[str], canonical: bool = True, strands: bool = False) -> DataFrame:
    """The carried columns and kmer (packed) of every window of `seq`; null and short sequences give none.

    With `strands` each window comes as it is (strand 0) and as a window of the reverse complement (strand 1),
    with pos, its place there, instead of once as the lesser of both.
    """
    if not 0 < k <= LONGEST:
        raise ValueError(f"k must be 1 to {LONGEST}")
    kinds = dict(reads.dtypes)
    extra = ["pos", "strand"] if strands else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column(len(carry))), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE)) + 1
            edges = [0, *cuts.tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield from each(whole.slice(a, b - a))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = pc.fill_null(batch.column(len(carry)).cast(pa.binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        row, place, word, other = windows(data, offsets - offsets[0], k)
        if not len(row):
            return
        owner = pa.array(row)
        carried = [batch.column(i).take(owner) for i in range(len(carry))]
        if not strands:
            yield pa.RecordBatch.from_arrays([*carried, pa.array(np.minimum(word, other) if canonical else word)], names=[*carry, "kmer"])
            return
        back = (offsets[1:] - offsets[:-1])[row] - k - place
        for strand, pos, value in ((0, place, word), (1, back, other)):
            yield pa.RecordBatch.from_arrays([*carried, pa.array(value), pa.array(pos, pa.int32()), pa.array(np.full(len(row), strand), pa.int32())], names=[*carry, "kmer", *extra])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "kmer long", *[f"{c} int" for c in extra]])
    return reads.select(*carry, "seq").mapInArrow(run, schema)
