"""Set operators, snapshots and synchronisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union(*parts: DataFrame, key: list[str] = ("name", "file", "line")) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(list(key))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that came and went between two snapshots: column ``change``."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    k = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("k_", k).where("k_ = 1").drop("k_")


def sync_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, updated, deleted or unchanged by size and digest."""
    j = old.select("path", F.col("size").alias("s0"), F.col("digest").alias("d0"), F.lit(1).alias("was")).join(new.select("path", F.col("size").alias("s1"), F.col("digest").alias("d1"), F.lit(1).alias("is")), "path", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when((F.col("s0") == F.col("s1")) & (F.col("d0") == F.col("d1")), "unchanged").otherwise("updated")
    return j.select("path", status.alias("status"))


def replace_edges(edges: DataFrame, fresh: DataFrame, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``edges`` with those of ``files`` replaced by ``fresh``; one row stays of each (src, dst, kind, line), the fresh one.

    ``tasks``: into how many the edges are dealt, for more of them than Spark's number suits.
    """
    kept = edges.join(files.select("file").distinct(), "file", "left_anti").withColumn("age_", F.lit(1))
    both = kept.unionByName(fresh.withColumn("age_", F.lit(0)))
    if tasks:
        both = both.repartition(tasks, "src", "dst")
    return first_of(both, ["src", "dst", "kind", "line"], ["age_", "file"]).select(*edges.columns)


def partition_changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that the cache doesn't hold with the same digest."""
    return files.join(cached.select("path", "digest"), ["path", "digest"], "left_anti")
