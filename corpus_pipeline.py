"""From raw documents to token ids: the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs.  All but the last return the columns
of ``documents``.

Null and empty texts pass the filtering stages: they are neither toxic nor near
duplicates, hold no passages, weigh nothing in the mix, and have no tokens.
Repeated rows are near duplicates of each other, so one stays.  Of near copies
the smallest id stays, of a repeated passage the document with the smallest id
keeps it, so no tie is left open.  Very long texts are processed whole in every
stage.  Columns that ``docs`` has beyond those of ``documents`` are carried along
to the last stage but one, whatever their names; the last returns its own
columns.  Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm import bpe, jaccard_join, mixture, session, substring_dedup, toxicity
from codequarry.llm.queries import table, tokenizer_file

#: SQL can't express a random field or a vocabulary's merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half.  The field is trained on the labelled documents of ``sf_dir``."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, 0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: the one with the smallest id.

    A row without an id, or a text without words, is its own component.  Texts
    that share an id are documents of their own: the first by digest goes by the
    id, the others by a key from a hash, which comes after ids below 2 ** 62.
    Rows with one id and text are one document, of which any one row of the
    least hash over all columns stays.

    Texts of documents that no decision touches are not shuffled.
    """
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    # Ids with several rows: their rows are told apart by digest.
    several = session.stash(whole.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated-ids", small=True)
    maybe, single = session.split_by_ids(whole, F.col("id"), several)
    maybe = maybe.join(several.withColumn("again", F.lit(True)), "id", "left").withColumn("digest", F.when(F.col("again"), digest))
    first = session.stash(maybe.where("again").groupBy("id").agg(F.min("digest").alias("first")), "first-digests", small=True)
    other = F.xxhash64("id", "digest").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = F.when(F.col("digest").isNull() | (F.col("digest") == F.col("first")), F.col("id")).otherwise(other)
    maybe = maybe.join(first, "id", "left").select("row", "text", key.alias("id"), F.coalesce("again", F.lit(False)).alias("again"))
    keyed = maybe.unionByName(single.select("row", "text", "id", F.lit(False).alias("again")))
    same = jaccard_join.similar_documents(keyed.select(F.col("id").alias("doc_id"), "text"))
    gone = session.stash(same.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "near-copies", small=True)
    maybe, kept = session.split_by_ids(keyed, F.col("id"), gone)
    left = kept.unionByName(maybe.join(gone, "id", "left_anti").select(*kept.columns))
    once = left.where("again").withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("row")))).where("n = 1")
    return left.where("not again").select("row.*").unionByName(once.select("row.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a text that is nothing else goes."""
    found = session.stash(substring_dedup.repeated_passages(docs), "passages")
    return substring_dedup.without_repeats(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the mix takes them: each as often as the block with its first word was selected."""
    return mixture.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes, for each row."""
    import public_tokenizers

    session.small_batches(spark)
    return bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over what the one before it kept.

    What a stage stored for itself is deleted when its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = session.mark()
        docs = session.stash(stage(spark, docs, sf_dir), f"stage-{name}")
        session.release(mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
