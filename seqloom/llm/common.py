"""Shared plumbing of the corpus operators: shared-folder tables, Arrow batches, word boundaries."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch, shared_dir

#: Bytes that separate words: space and the ASCII controls tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
__all__ = ["IS_SPACE", "SLICE_BYTES", "SPACES", "WORD", "Scratch", "flat_bytes", "give_back", "map_arrow", "shared_dir", "slices", "table", "texts_of", "tokenizer_path", "word_spans"]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one kernel call handles at a time (a single longer text goes alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], by: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column `by` holds about `most` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and row offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word in the flat bytes, and for each row its first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[offsets < len(data)]] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = edge[1:].copy()
    last[-1] = True
    ends = np.flatnonzero(inside & (~after | last)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after whose last batch the memory that it no longer uses goes back to the system: Spark keeps idle workers beside the stages that follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only some C libraries have it
            pass

    return task


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema, by: str, most: int = SLICE_BYTES) -> DataFrame:
    """Applies `kernel` to slices of each Arrow batch; memory is bounded by the slice and the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, by, most):
            yield kernel(part)

    return df.mapInArrow(give_back(run), schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Default place of a public vocabulary; every operator takes another path as a parameter."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)
