"""Substring removal by hashing lines.

Units are the lines of a text. Two finer kinds of unit, which parameters may leave out, find passages that
stand inside longer lines: the sentences of a line (up to . ! or ? before white space), and pairs of
neighbouring chunks of words. Chunks run over the whole text and are cut where the hash of two successive
words is the least within CHUNK_REACH words, so equal passages are cut alike wherever they stand (chunks have
some 7 words). Words, lower-cased, are digested; digests are grouped over the whole corpus, and the earliest
occurrence by (doc_id, hash of the text, start) is kept. Later occurrences go: whole lines of LINE_WORDS words
or more, and runs of successive repeated sentences or pairs of chunks that have RUN_WORDS words or more. Up to
two chunks at a passage's ends may stay. What goes is given as spans of the original text, in code points, ends
exclusive; spans that overlap are one, kept by the smallest id that keeps a unit of it.

Null and empty texts have no units; an empty table gives no rows. Rows with the same id and text count as one
row and keep their first occurrence; the same id with another text is a row of its own. Rows without id come
first. Ids may have any orderable type. Very long texts are handled whole. Columns other than id and text aren't
read, so their names can't clash; remove_spans passes them on. Digests have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import IS_SPACE, Scratch, flat_bytes, map_arrow, word_spans
from .text_kernel import LOWER, STEPS, U, hash_units, line_spans, mix

#: Words of the shortest line, and of the shortest run of finer units, that goes: shorter ones recur by chance and in boilerplate.
LINE_WORDS = 15
RUN_WORDS = 15
SLICE = 512 << 10
SENTENCE, LINE, CHUNKS = 0, 1, 2
CHUNK_REACH = 3
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digest of each run words[first:last] of word hashes; runs follow one another and aren't empty."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = np.full(int(size.max()), STEPS[11], dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = words[inner + np.repeat(first, size)] * power[inner]
    return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))


def chunk_starts(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each word: at a row's first word, and where the hash of a word and the next is least nearby."""
    if not len(words):
        return np.zeros(0, dtype=bool)
    follow = np.zeros(len(words), dtype=np.uint64)  # none after a row's last word
    follow[:-1] = np.where(owner[1:] == owner[:-1], words[1:], U(0))
    pair = mix(words * STEPS[11] + follow)
    least = np.ones(len(words), dtype=bool)
    for d in range(1, CHUNK_REACH + 1):
        same = owner[d:] == owner[:-d]
        least[d:] &= ~same | (pair[d:] < pair[:-d])
        least[:-d] &= ~same | (pair[:-d] <= pair[d:])
    least[0] = True
    least[1:] |= owner[1:] != owner[:-1]
    return least


def units(data: np.ndarray, offsets: np.ndarray, kinds: tuple[int, ...] = (SENTENCE, LINE, CHUNKS), line_words: int = LINE_WORDS) -> dict[str, np.ndarray]:
    """All units of the rows, of the kinds asked for: row, kind, number within row and kind, start and end (code points), first word's place, words, digest."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts, ends, first = word_spans(data, offsets)
    words = hash_units(LOWER[data], starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = []
    ls, le, lrow = line_spans(data, offsets)
    a, b = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    if len(words):
        line_of = np.repeat(np.arange(len(ls)), b - a)
        stop = _END[data[ends - 1]]
        fresh = np.ones(len(words), dtype=bool)
        fresh[1:] = stop[:-1] | (line_of[1:] != line_of[:-1])
        sa = np.flatnonzero(fresh)
        sb = np.append(sa[1:], len(words))
        out.append((owner[sa], SENTENCE, sa, sb))
        ca = np.flatnonzero(chunk_starts(words, owner))
        cb = np.append(ca[1:], len(words))
        both = np.flatnonzero(owner[ca[1:]] == owner[ca[:-1]])
        out.append((owner[ca[both]], CHUNKS, ca[both], cb[both + 1]))
    big = (b - a) >= line_words
    out.append((lrow[big], LINE, a[big], b[big]))
    parts = []
    for row, kind, x, y in (o for o in out if o[1] in kinds):
        begin = np.searchsorted(row, row)
        parts.append((row, np.full(len(row), kind), np.arange(len(row)) - begin, chars[starts[x]] if len(x) else x, chars[ends[y - 1]] if len(x) else x, x - first[row] if len(x) else x, y - x, digests(words, x, y)))
    row, kind, number, start, end, place, count, digest = (np.concatenate(p) for p in zip(*parts))
    base = chars[offsets[row]] if len(row) else 0
    return {"row": row, "kind": kind, "number": number, "start": start - base, "end": end - base, "place": place, "words": count, "digest": digest}


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[int, ...] = (SENTENCE, LINE, CHUNKS), line_words: int = LINE_WORDS) -> DataFrame:
    """One row per unit: digest, doc_id, version (hash of the text), kind, number, start, stop, place (of its first word), words."""
    of = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        u = units(*flat_bytes(batch.column(2)), kinds, line_words)
        at = pa.array(u["row"])
        return pa.RecordBatch.from_arrays(
            [pa.array(u["digest"].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), *[pa.array(u[c], pa.int32()) for c in ("kind", "number", "start", "end", "place", "words")]],
            names=["digest", "doc_id", "version", "kind", "number", "start", "stop", "place", "words"],
        )

    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    return map_arrow(rows, kernel, f"digest long, doc_id {of}, version long, kind int, number int, start int, stop int, place int, words int", "text", SLICE)


def repeated_spans(docs: DataFrame, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS, sentences: bool = True, chunks: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to remove: doc_id, version, start, stop, n_words, kept_doc_id (the smallest that keeps a copy of a unit of it).

    The earliest occurrence of each digest comes from a partial aggregation and is written out, so that the
    join back to the units has a plain table of one row per digest on its other side: adaptive execution
    can then split a frequent line, which is never gathered.
    """
    every = unit_table(docs, id_col, text_col, (LINE, *[SENTENCE] * sentences, *[CHUNKS] * chunks), line_words)
    first = Scratch(docs.sparkSession).cut(every.groupBy("digest", "kind").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "start")).alias("first")).where("n > 1").select("digest", "kind", "first"))
    place = F.struct("doc_id", "version", "start")
    later = every.join(first, ["digest", "kind"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "kind", "number", "start", "stop", "place", (F.col("place") + F.col("words")).alias("upto"), F.col("first.doc_id").alias("kept"))
    row = W.partitionBy("doc_id", "version")
    inner = W.partitionBy("doc_id", "version", "kind").orderBy("number")
    # Repeated rows give each unit several times; the dense rank and the lag count it once.
    runs = later.withColumns({"run": F.col("number") - F.dense_rank().over(inner), "last": F.lag("number").over(inner)}).where("last is null or last <> number")
    runs = runs.withColumn("run", F.when(F.col("kind") == LINE, F.col("number")).otherwise(F.col("run")))
    found = runs.groupBy("doc_id", "version", "kind", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("place").alias("place"), F.max("upto").alias("upto"), F.min("kept").alias("kept"))
    found = found.where((F.col("kind") == LINE) | (F.col("upto") - F.col("place") >= run_words))
    order = row.orderBy("start", F.col("stop").desc(), "kind")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    joined = found.withColumn("opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    words = (F.max("upto") - F.min("place")).cast("long").alias("n_words")
    return joined.groupBy("doc_id", "version", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), words, F.min("kept").alias("kept_doc_id")).drop("span")


def remove_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without their spans; the spans of one row (bounded by its length) are applied right to left."""
    ranges = spans.groupBy("doc_id", "version").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "stop")))).alias("cuts"))
    cols = docs.columns
    own = docs.withColumn("_version", F.xxhash64(docs[text_col]))
    ranges = ranges.select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "cuts")
    joined = own.join(ranges, own["doc_id"].eqNullSafe(ranges["_id"]) & (own["_version"] == ranges["_v"]), "left")
    cut = F.aggregate(
        F.coalesce("cuts", F.array().cast("array<struct<start:int,stop:int>>")), F.col(text_col),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substring(t, s["stop"] + 1, F.length(t))),
    )
    return joined.withColumn(text_col, cut).select(*cols)
