"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id's text divisible by 5; a null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all labelled rows that aren't held out.

    Labels other than 0 and 1 are ignored, of repeated labels the largest counts.
    """
    usable = F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return labels.where(usable).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, zeros: int, ones: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``zeros`` and ``ones`` training rows of the two classes, chosen by a hash of the id.

    With ``most_bytes`` each class is also bounded by its share of them: whole
    texts are taken in the order of the hash while they fit.
    """
    ids = training_labels(labels, label)
    first = [ids.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((0, zeros), (1, ones))]
    chosen = first[0].unionByName(first[1])  # at most zeros + ones ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if most_bytes is not None:
        sizes = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.sum("size").alias("size"))
        limit = F.when(F.col("label") == 0, most_bytes * zeros // (zeros + ones)).otherwise(most_bytes * ones // (zeros + ones))
        order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
        chosen = sizes.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= limit).select("doc_id", "label")
    return rows.join(F.broadcast(chosen), "doc_id")
