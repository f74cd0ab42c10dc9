"""Vectorised text kernels over the flat bytes of a batch: unit hashes, windows, per-text statistics.

Units (words, lines) are hashed by position tables of random 64-bit words, so two different units
agree with probability 2**-64; what is counted as equal below is equal up to that.
"""

from __future__ import annotations

import numpy as np

from .common import IS_SPACE, word_spans

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(0, 1 << 64, size=(256, 256), dtype=np.uint64, endpoint=False).ravel()
STEPS = _rng.integers(0, 1 << 63, size=16, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of a public hash)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def hash_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each unit data[start:end]; units don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum()), dtype=np.int64)
    place = inner - np.repeat(first, size)
    raw = data[inner + np.repeat(starts - first, size)]
    value = TABLE[((place & 255) << 8) | raw]
    if size.max() > 256:
        value = value * ((place >> 8).astype(np.uint64) * U(2) + U(1))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * STEPS[0])


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of k words from each place, and the row of that place; only places with k words in their row.

    first: index of each row's first word, with the total at the end.
    """
    rows = len(first) - 1
    count = np.diff(first)
    fits = np.maximum(count - (k - 1), 0)
    row = np.repeat(np.arange(rows), fits)
    at = np.arange(len(row)) + np.repeat(first[:-1] - (np.cumsum(fits) - fits), fits)
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        total += words[at + j] * STEPS[1 + j]
    return mix(total), row


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (A-Z lower-cased) of each row, ordered by row and hash.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = hash_units(data, starts, ends)
    value, row = windows(words, first, k)
    count = np.diff(first)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            total = np.full(len(short), STEPS[10], dtype=np.uint64) * U(n)
            for j in range(n):
                total += words[first[short] + j] * STEPS[1 + j]
            value = np.concatenate([value, mix(total)])
            row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], row[keep]


def ordered(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within their rows; rows come in order already."""
    if not len(row):
        return value, row
    bounds = np.flatnonzero(np.diff(row)) + 1
    value = value.copy()
    edges = [0, *bounds.tolist(), len(row)]
    for a, b in zip(edges, edges[1:]):
        value[a:b].sort()
    return value, row


def repeats(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Marks every value that its row has twice or more."""
    key = value + mix(row.astype(np.uint64) + U(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def distinct(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    value, row = ordered(value, row)
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line that has a word; lines end at \\n."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([breaks, breaks + 1, offsets]))
    starts, ends = cuts[:-1], cuts[1:]
    words = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    keep = words[ends] > words[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Byte classes whose counts are features.
CLASSES = ("space", "newline", "digit", "upper", "lower", "symbol", "stop", "mark", "lead", "rest")
_KIND = np.full(256, CLASSES.index("mark"), dtype=np.uint8)
_KIND[IS_SPACE] = CLASSES.index("space")
_KIND[10] = CLASSES.index("newline")
_KIND[ord("0") : ord("9") + 1] = CLASSES.index("digit")
_KIND[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
_KIND[ord("a") : ord("z") + 1] = CLASSES.index("lower")
_KIND[list(b"#*$%&|<>")] = CLASSES.index("symbol")
_KIND[list(b".,;:")] = CLASSES.index("stop")
_KIND[0xC0:] = CLASSES.index("lead")
_KIND[0x80:0xC0] = CLASSES.index("rest")


def text_stats(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each row: byte classes, words and their code points, repeated lines, words in repeated windows."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32) * len(CLASSES), np.diff(offsets))
    kinds = np.bincount(row + _KIND[data], minlength=rows * len(CLASSES)).reshape(rows, -1)
    out = {name: kinds[:, i] for i, name in enumerate(CLASSES)}
    starts, ends, first = word_spans(data, offsets)
    words = hash_units(data, starts, ends)
    out["words"] = np.diff(first)
    out["word_chars"] = np.diff(offsets) - out["space"] - out["newline"] - out["rest"]
    owner = np.repeat(np.arange(rows), out["words"])
    out["distinct_words"] = distinct(words, owner, rows)
    longest = np.zeros(rows, dtype=np.int64)
    some = np.flatnonzero(out["words"])
    if len(some):
        longest[some] = np.maximum.reduceat(ends - starts, first[some])
    out["longest_word"] = longest
    value, wrow = windows(words, first, window)
    again = repeats(value, wrow)
    fits = np.maximum(out["words"] - (window - 1), 0)
    at = np.arange(len(wrow)) + np.repeat(first[:-1] - (np.cumsum(fits) - fits), fits)
    covered = np.zeros(len(words), dtype=bool)
    for j in range(window):
        covered[at[again] + j] = True
    out["repeat_words"] = np.bincount(owner[covered], minlength=rows)
    ls, le, lrow = line_spans(data, offsets)
    out["lines"] = np.bincount(lrow, minlength=rows)
    out["dup_lines"] = out["lines"] - distinct(hash_units(data, ls, le), lrow, rows)
    out["word_hashes"], out["first_word"] = words, first
    return out
