"""The contract queries opN_<name> over the corpus tables, each a thin layer over its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, media_gif, mixing, ngram_join, pii, quality_gam, quality_rules, token_counts, url_filters
from .common import table
from .labelled import held_out


#: The rules that the contract fixes: verdict, host, path prefix.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("alias_class")


def op2_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a GIF, read back: payload and media digests, histogram feature."""
    docs = table(spark, sf_dir, "documents")
    stored = media_gif.encode_texts(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = media_gif.decode(stored, channels="R", carry=("n_bytes", "media_bytes", "media_sha256"))
    payload = F.array_join(F.transform("frames", lambda f: F.hex(f["rgba"])), "")
    shown = F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["frame"], f["start_cs"], F.array_join(f["red"].cast("array<string>"), "/"))), ",")
    back = back.select("doc_id", "n_bytes", "media_bytes", "media_sha256", F.when(F.size("frames") == 1, F.col("frames")[0]["rgba"]).otherwise(F.unhex(payload)).alias("payload"), shown.alias("feature"))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its training positions, in the order in which the curriculum trains on them."""
    mixed = mixing.training_order(table(spark, sf_dir, "documents"))
    at = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("n_copies"), at(1).alias("first_position"), at(-1).alias("last_position"))


def curriculum_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, with its training position, in order of position."""
    return mixing.curriculum(table(spark, sf_dir, "documents")).select("doc_id", "copy", "position", "size", "source")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that repeat an earlier one, with the document that keeps them."""
    spans = line_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start", "stop", "n_words", "kept_doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the calibrated n-gram classifier over every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive-model score of every document, learnt from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), keep=~held_out(F.col("doc_id")))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), back=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest of the base spans, and all spans of every document."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") > 0).alias("found"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


ORACLE_SQL: dict[str, str] = {"op1_url_filters": url_filters.sql(URL_RULES), "op4_mixing": mixing.SQL, "op8_ngram_join": ngram_join.SQL}


def queries() -> dict:
    return {q.__name__: q for q in (op1_url_filters, op2_media_gif, op3_token_counts, op4_mixing, curriculum_copies, op5_line_dedup, op6_quality_rules, op7_quality_gam, op8_ngram_join, op9_bpe, op10_pii)}
