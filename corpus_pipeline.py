"""Corpus pipeline: quality, near duplicates, personal data, source mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again as the next one's docs. All but the last return the columns of documents.

Null texts count as empty ones; empty texts are scored, never linked, and give no words and no tokens. Rows of
one id with different texts are documents of their own; repeated rows are one document to the near-duplicate
stage and rows of their own elsewhere. Ties (equal texts, equal positions) go by id and by hashes, so reruns
agree. Very long texts are handled whole. Extra columns pass unchanged under any name. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, mixing, ngram_join, pii, quality_gam
from seqloom.llm.common import Scratch, table
from seqloom.llm.labelled import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't reject."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), keep=~held_out(F.col("doc_id")))
    scored = quality_gam.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= quality_gam.THRESHOLD).select(*docs.columns)


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ... that clash with nothing, and the new names of doc_id and text."""
    names = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns)))))
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, that of the least hash; a repeated row is reduced before it is dealt."""
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.xxhash64(*rows.columns)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, "row.*").select(*rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that of the smallest id (one without id last; of equal ids, that of the smaller hash)."""
    scratch = Scratch(spark)
    rows = scratch.cut(ngram_join.similar_rows(docs).where("group is not null"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("f")
    first = scratch.cut(rows.groupBy("group").agg(first).select("group", F.col("f.doc_id").alias("kept_id"), F.col("f.version").alias("kept")), rows.count())
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    lost = rows.join(first, "group").where(~(same("doc_id", "kept_id") & same("version", "kept")))
    lost = scratch.cut(lost.select("doc_id", "version").distinct(), rows.count())
    again = scratch.cut(rows.groupBy("doc_id", "version").count().where("count > 1").select("doc_id", "version"), rows.count())
    plain, key, text = _plain(docs)
    marked = plain.withColumn("hash", F.xxhash64(text))
    on = same(key, "doc_id") & (F.col("hash") == F.col("version"))
    kept = marked.join(ngram_join.small(lost), on, "left_anti")
    if again.head(1):
        repeated = _one_each(kept.join(ngram_join.small(again), on, "left_semi"), [key, "hash"])
        kept = kept.join(ngram_join.small(again), on, "left_anti").union(repeated)
    return kept.drop("hash").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the curriculum takes, in order of their training position."""
    scratch = Scratch(spark)
    plain, key, _ = _plain(docs)
    marked = plain.withColumn("hash", F.xxhash64(*plain.columns))
    slim = docs.select("doc_id", "source", "text", F.xxhash64(*docs.columns).alias("version"))
    placed = scratch.cut(mixing.assign(slim, carry=("version",)).select("doc_id", "version", "positions"), docs.count())
    on = F.col(key).eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("version"))
    # Equal rows are one row that has the copies of all of them.
    again = scratch.cut(placed.groupBy("doc_id", "version").count().where("count > 1").select("doc_id", "version"), placed.count())
    if again.head(1):
        repeated = _one_each(marked.join(ngram_join.small(again), on, "left_semi"), [key, "hash"])
        marked = marked.join(ngram_join.small(again), on, "left_anti").union(repeated)
    copies = scratch.cut(placed.select("doc_id", "version", F.explode("positions").alias("position")), 3 * placed.count())
    sorted_ = marked.join(ngram_join.small(copies), on).orderBy("position", key, "hash")
    return sorted_.select(*plain.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the text decoded from them."""
    coded = bpe.encode(docs, back=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", tokens),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = scratch.write(docs)
            if last:
                scratch.drop(last)
            last = path
    return docs
