"""Sequence and presence views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import letter_slices
from ..operators.presence import spread

LETTERS = "abcdefghijklmnopqrstuvwxyz "
CYCLE = ("ACGT" * 7)[: len(LETTERS)]
READ = 100
#: Texts made sets at a time, and words whose hashes a task keeps.
SETS_AT_ONCE, KNOWN_WORDS = 1000, 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """sample_id, source, read_no and seq: documents written in four letters, in reads of 100.

    whole: all reads of a sample follow each other in one partition. So they do unless an id has several rows.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    if whole and not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.repartition("doc_id").sortWithinPartitions("doc_id")
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "source", F.lower("text").alias("text")).mapInArrow(_cut, f"sample_id {kinds['doc_id']}, source {kinds['source']}, read_no int, seq string")


#: The letter of each byte of a lower-cased text; 0 for the further bytes of a character.
_LETTER = np.full(256, ord("N"), dtype=np.uint8)
_LETTER[0x80:0xC0] = 0
for _a, _b in zip(LETTERS, CYCLE):
    _LETTER[ord(_a)] = ord(_b)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads of texts; the reads of a batch, put together, are its letters, so only their offsets are made."""
    for batch, data, offsets in letter_slices(batches, 2):
        dna = _LETTER[data]
        letter = dna > 0
        if not letter.all():
            offsets, dna = np.concatenate([[0], np.cumsum(letter)])[offsets], dna[letter]
        count = -(-np.diff(offsets) // READ)
        row = np.repeat(np.arange(len(count)), count)
        no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        edges = np.append(offsets[row] + no * READ, len(dna)).astype(np.int32)
        owner = pa.array(row)
        seq = pa.StringArray.from_buffers(len(row), pa.py_buffer(edges), pa.py_buffer(dna))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(no.astype(np.int32)), seq], names=["sample_id", "source", "read_no", "seq"])


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as alignments: the source is the reference, with a quality made from the ids."""
    return reads(spark, sf_dir).select(F.concat(F.col("source"), F.lit("|x")).alias("rname"), F.pmod(F.col("sample_id") * 7 + F.col("read_no"), F.lit(61)).cast("int").alias("mapq"), "seq")


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmer (a part key) and sample_id (a customer key): who bought a part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("l_partkey").alias("kmer"), F.col("o_custkey").alias("sample_id")).distinct()


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmer (doc_id) and sample_id (a word of more than 3 letters): documents as sets of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[ \n\t]+"), lambda w: F.length(w) > 3))
    return docs.select(F.col("doc_id").alias("kmer"), F.explode(words).alias("sample_id"))


def doc_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmer (doc_id) and samples: the sorted hashes of a document's words of more than 3 letters, the first 64 bits of their md5.

    Made from each row in place; only texts of a repeated id are brought together. Different words have one hash with probability 2**-64.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return _word_sets(spread(docs))
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    parts = _word_sets(docs.join(again, same, "left_semi"))
    whole = parts.groupBy("kmer").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))).alias("samples"))
    return _word_sets(docs.join(again, same, "left_anti")).union(whole)


def word_hash(c: Column) -> Column:
    """The hash of sketches (`portable_hash` of a word) from the word's 64 bits."""
    return F.shiftrightunsigned(c, 4)


class _Words(dict):
    """The 64-bit hash of each word that is asked for; 0 for words of 3 letters or less."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True) if len(word) > 3 else 0
        return found

    def of(self, text: str) -> np.ndarray:
        words = set(text.replace("\n", " ").replace("\t", " ").split(" "))
        value = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        value.sort()
        return value[value != 0]


def _word_sets(docs: DataFrame) -> DataFrame:
    """kmer and samples of rows doc_id, text that have such a word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                part = batch.slice(at, SETS_AT_ONCE)
                sets = [known.of(text or "") for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["kmer", "samples"]).filter(pa.array(np.diff(ends) > 0))

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(kernel, f"kmer {dict(docs.dtypes)['doc_id']}, samples array<bigint>")


def word_count(spark: SparkSession, sf_dir: str) -> int:
    """The number of different words of more than 3 letters (of their hashes): tasks send each one once, or again after KNOWN_WORDS others."""

    def deal(new: list[np.ndarray]) -> pa.RecordBatch:
        value = np.unique(np.concatenate(new)).view(np.uint64)
        value = np.sort(value)
        part = (value >> np.uint64(56)).astype(np.int32)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        edges = np.append(first, len(value))
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([value[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["part", "words"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, new, size = _Words(), set(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                text = " ".join(t for t in batch.column(0).slice(at, SETS_AT_ONCE).to_pylist() if t)
                fresh = set(known.of(text).tolist()) - seen
                seen |= fresh
                new.append(np.fromiter(fresh, np.int64, len(fresh)))
                size += len(fresh)
                if size > KNOWN_WORDS:
                    yield deal(new)
                    seen, new, size = set(), [], 0
        if size:
            yield deal(new)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])
                    now, held = part, np.zeros(0, np.uint64)
                held = np.union1d(held, np.frombuffer(words, np.uint64))
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

    sent = spread(table(spark, sf_dir, "documents").select("text")).select(F.lower("text").alias("text")).mapInArrow(words, "part int, words binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: The same as common table expressions.
H = "('0x' || substr(md5({}::VARCHAR), 1, 15))::BIGINT"


def h(expression: str) -> str:
    return H.format(expression)


READS_SQL = f"""dna AS (SELECT doc_id AS sample_id, source, regexp_replace(translate(lower(text), '{LETTERS}', '{CYCLE}'), '[^ACGT]', 'N', 'g') AS dna FROM documents WHERE length(text) > 0),
reads AS (SELECT sample_id, source, i::INT AS read_no, substr(dna, (i * {READ} + 1)::BIGINT, {READ}) AS seq FROM dna, LATERAL unnest(range(0, (length(dna) - 1) // {READ} + 1)) AS t(i))"""
WINDOWS_SQL = READS_SQL + """,
windows AS (SELECT sample_id, source, read_no, seq, (p - 1)::INT AS pos, substr(seq, p::BIGINT, 20) AS word FROM reads, LATERAL unnest(range(1, length(seq) - 18)) AS t(p)),
kmers AS (SELECT sample_id, source, least(word, reverse(translate(word, 'ACGT', 'TGCA'))) AS kmer FROM windows WHERE word NOT LIKE '%N%')"""
BUYERS_SQL = "buyers AS (SELECT DISTINCT l_partkey AS kmer, o_custkey AS sample_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
WORDS_SQL = r"""doc_words AS (SELECT doc_id AS kmer, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \n\t]+'), lambda w: length(w) > 3))) AS sample_id FROM documents)"""
ABUNDANT_SQL = WINDOWS_SQL + """,
counts AS (SELECT kmer, count(DISTINCT sample_id)::BIGINT AS n FROM kmers GROUP BY kmer),
abundant AS (SELECT kmer, n FROM counts WHERE n >= 8)"""
