"""Byte-level BPE by batched numpy merge rounds.

The symbols of many distinct pre-tokens lie in one flat array. Each round looks every adjacent pair
up by binary search over the sorted pair keys, finds each word's lowest rank, and merges all its
non-overlapping occurrences, leftmost first; words without a known pair leave the array. A word of more
than LONG_WORD bytes has rounds of its own, one a rank, that touch only the pairs of this rank, so that
a text without spaces takes time by its length and not its square. Finished words stay in a bounded
cache of the worker, so a frequent word is merged once.

Null and empty texts give no tokens; an empty table gives no rows. Special tokens that stand in a text are
one id, as in the vocabulary file. Rows are independent: repeated rows and ties have no effect, very long
texts are handled whole, and other columns than id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from .common import map_arrow, texts_of, tokenizer_path

#: Fixed value: the published pre-token pattern of this vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts without RARE characters, in terms of the faster standard module: below
#: U+0530 the numbers that are no decimal digits, and the white space of Python alone, are listed there.
COMMON = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
RARE = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0530-\U0010ffff]"
#: Words, and bytes of words, from which on a worker's cache is emptied; longer words than LONG_WORD bytes have rounds of their own.
CACHE_WORDS, CACHE_BYTES, LONG_WORD = 200_000, 16 << 20, 512
#: Text bytes that one kernel call handles.
SLICE = 1 << 20
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that the vocabulary file writes for each byte value."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return letters


@cache
def _unassigned() -> re.Pattern:
    spans, start = [], None
    for c in range(sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


def unassigned(text: str) -> re.Match | None:
    """A character that this Python's Unicode tables do not know, and newer ones may."""
    return _unassigned().search(text)


class Vocabulary:
    """Tables of a byte-level BPE file: byte ids, sorted pair keys with ranks, token bytes."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = [(a, b, c) for a, b, c in zip((keys // self.size).tolist(), (keys % self.size).tolist(), made.tolist())]
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int32)
        pieces = [b""] * self.size
        for word, i in ids.items():
            pieces[i] = bytes(back[c] for c in word)
        for word, i in self.special.items():
            pieces[i] = word.encode()
        self.piece_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.split, self.common, self.rare = regex.compile(SPLIT), re.compile(COMMON), re.compile(RARE).search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {s: k for k, s in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), dtype=np.uint32)
        self.ends = np.arange(1, 1 + len(self.special), dtype=np.int64)
        self.held = 0

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token is one of its own."""
        if self.rare(text):
            split = self.split.findall if unassigned(text) is None else self.published
        else:
            split = self.common.findall
        if self.cut is None or not any(s in text for s in self.special):
            return split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else split(part)
        return out

    @staticmethod
    def published(text: str) -> list[str]:
        """Pre-tokens by the library itself, whose tables may know characters that the pattern's do not."""
        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, as uint32, and where each text begins in it."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        known, index, counts = self.known, [], []
        before = len(known)
        for text in texts:
            words = self.words(text)
            index += [known.setdefault(w, len(known)) for w in words]
            counts.append(len(words))
        if len(known) > before:
            fresh = [w.encode() for w in islice(reversed(known), len(known) - before)][::-1]
            self.held += sum(map(len, fresh))
            flat, ends = self.merge_words(fresh)
            self.ends = np.concatenate([self.ends, ends + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        at = np.array(index, dtype=np.int64)
        stops = self.ends[at]
        size = stops - np.where(at > 0, self.ends[at - 1], 0)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(stops - total[1:], size) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word ends."""
        alone = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not alone:
            return self.merge_short(words)
        apart = set(alone)
        flat, ends = self.merge_short([b"" if i in apart else w for i, w in enumerate(words)])
        parts, at = [], 0
        size = np.diff(ends, prepend=0)
        for i in alone:
            one = self.merge_long(words[i])
            parts += [flat[at : ends[i]], one]
            at, size[i] = ends[i], len(one)
        return np.concatenate([*parts, flat[at:]]), np.cumsum(size)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word. A round merges all pairs of the lowest rank, found in lists of places by rank; symbols are linked to their neighbours."""
        sym = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].astype(np.int64)
        n = len(sym)
        after, before, gone = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(place: np.ndarray) -> None:
            rank = self.look(sym[place], sym[after[place]])
            place, rank = place[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[order])) + 1
            for part in np.split(place[order], cuts) if len(place) else []:
                r = int(self.look(sym[part[:1]], sym[after[part[:1]]])[0])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            place = np.unique(np.concatenate(waiting.pop(r)))
            left, right, made = self.by_rank[r]
            place = place[~gone[place] & (after[place] < n)]
            place = place[(sym[place] == left) & (sym[after[place]] == right)]
            if left == right and len(place) > 1:
                joined = np.concatenate([[False], after[place[:-1]] == place[1:]])
                index = np.arange(len(place))
                begin = np.maximum.accumulate(np.where(joined, 0, index))
                place = place[(index - begin) % 2 == 0]
            if not len(place):
                continue
            eaten = after[place]
            sym[place], gone[eaten] = made, True
            after[place] = far = after[eaten]
            before[far[far < n]] = place[far < n]
            ahead = before[place]
            wait(np.concatenate([ahead[ahead >= 0], place[far < n]]))
        return sym[~gone].astype(np.uint32)

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all words at once: their ids in one array, and where each word ends."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NONE)
            made = np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                key = sym[:-1] * self.size + sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
                made[:-1][hit] = self.made[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best < NONE
            if not open_.all():
                done.append((word[~open_], sym[~open_]))
            take = (rank == best) & open_
            # In a run of equal symbols neighbouring pairs overlap: every second one merges, from the left.
            place = np.flatnonzero(take)
            if len(place) > 1:
                joined = np.concatenate([[False], np.diff(place) == 1])
                if joined.any():
                    index = np.arange(len(place))
                    begin = np.maximum.accumulate(np.where(joined, 0, index))
                    place = place[(index - begin) % 2 == 0]
            sym[place] = made[place]
            keep = open_
            keep[place + 1] = False
            sym, word = sym[keep], word[keep]
        owner = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        out = np.concatenate([s for _, s in done]).astype(np.uint32) if done else np.zeros(0, np.uint32)
        order = np.argsort(owner, kind="stable")
        return out[order], np.cumsum(np.bincount(owner, minlength=len(words)))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, special tokens included."""
        if not len(ids):
            return b""
        size = self.piece_len[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.piece_at[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.piece_bytes[source].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """One Vocabulary for each file and worker."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, back: bool = False) -> DataFrame:
    """Rows of id, n_tokens and ids (packed little-endian unsigned 32-bit) for every document; with `back` also `decoded`, the text read back from the packed ids.

    The vocabulary file is read on the driver and travels with the tasks (1.5 MB, whatever the corpus).
    """
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(spec)
        ids, edges = v.encode_many(texts_of(batch.column(1)))
        packed = ids.astype("<u4").tobytes()
        cuts = (4 * edges).tolist()
        each = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        columns = {"id": batch.column(0), "n_tokens": pa.array(np.diff(edges), pa.int64()), "ids": pa.array(each, pa.binary())}
        if back:
            columns["decoded"] = pa.array([v.decode(np.frombuffer(x, dtype="<u4")) for x in each], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * back
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kernel, schema, "text", SLICE).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The text of packed ids (column `ids`), malformed UTF-8 replaced; `carry` columns pass unchanged. Null ids give an empty text."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    cols = [id_col, *carry, "ids"]
    kinds = dict(encoded.select(*cols).dtypes)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(spec)
        out = [v.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*cols, "decoded"])

    return map_arrow(encoded.select(*cols), kernel, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", decoded string", "ids", SLICE)
