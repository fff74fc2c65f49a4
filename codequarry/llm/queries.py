"""The registered queries: thin wrappers that apply the operators to whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, jaccard_join, media, mixture, quality, revisits, session, substring_dedup, token_counts, toxicity
from .labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def run_folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder for what a query keeps between calls over the same tables in one application."""
    key = hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:16]
    return f"{session.shared_dir(spark)}/{name}-{key}"


def warc_records(pages: DataFrame) -> DataFrame:
    """Two records a page: its full response, and a later (for some an earlier) not-modified revisit.

    ``pages`` holds captures without WARC fields, so dates and validators are
    derived from page_id, url and html alone.
    """
    p = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    nibble = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")), 1, 1)) - 1
    p = p.select("page_id", "url", nibble.alias("h"), F.md5(F.col("html").cast("binary")).alias("etag"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    head = lambda *kv: F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())
    stamp = F.concat(F.lit("lm-"), F.col("h").cast("string"))
    full = p.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(at).alias("warc_date"), F.lit(200).alias("http_status"),
        head(F.lit("etag"), F.col("etag"), F.lit("last-modified"), stamp, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.col("digest").alias("payload_digest"), F.col("size").alias("n_bytes"),
    )
    asked = at + F.when(F.col("h") == 3, -7200).otherwise(129_600)
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(asked).alias("warc_date"), F.lit(304).alias("http_status"),
        head(F.lit("etag"), F.when(F.col("h") == 7, F.lit("changed")).otherwise(F.col("etag")), F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("h").cast("string")), F.lit("content-type"), F.lit("text/plain")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("bigint").alias("n_bytes"),
    )
    return full.unionByName(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revisits.resolve(warc_records(table(spark, sf_dir, "pages")))
    return r.select(
        ((F.col("record_id") - 1) / 2).cast("bigint").alias("page_id"), "canonical_url", "status", "response_id", F.unix_timestamp("response_date").alias("response_epoch"), "http_status",
        F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"), F.col("headers")["content-type"].alias("content_type"), F.col("headers")["cache-control"].alias("cache_control"), "payload_digest", "n_bytes",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), run_folder(spark, "token-counts", sf_dir), fold=True, by_words=True)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.small_batches(spark)
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), spans=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    session.small_batches(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_revisits, op2_token_counts, op3_source_mix, op4_embedding_near_dedup, op5_signature_sniffing, op6_compact_windows, op7_toxic_spans, op8_quality_rules, op9_ngram_jaccard_join, op10_byte_bpe)
}
