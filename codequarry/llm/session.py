"""Shared storage and batch settings taken from the Spark session."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 2048
BATCH_BYTES = 4 << 20
#: Words of 64 bits of the filter of ids that scans test: 2 MB of bits.
WORDS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master, as in tests, may do without one: a temporary folder is
    set there.  Elsewhere executors would write to their own disks, so a session
    without the setting is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="codequarry-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts don't pile up in one batch.

    These two settings stay, as frames that operators return are run later, and
    are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def id_filter(ids: DataFrame) -> DataFrame:
    """(word, bits) with WORDS rows at most, whatever the number of ``ids`` (column id): which hashes occur.

    A hash that doesn't occur is none of the ids for sure; when there are very
    many ids nearly every hash occurs, and the filter leaves everything to the
    join behind it.
    """
    h = F.xxhash64("id")
    at = ids.where("id is not null").select(F.pmod(h, F.lit(WORDS)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")).alias("bit"))
    return stash(at.groupBy("word").agg(F.bit_or("bit").alias("bits")), "id-filter", small=True)


def split_by_ids(df: DataFrame, column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``split`` by the filter of ``ids`` (column id)."""
    return split(df, column, id_filter(ids))


def split(df: DataFrame, column, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` may be among the ids of the filter ``test``, and those for which it isn't.

    Nothing is shuffled; the join that decides about the first part is left to
    the caller.  ``df`` must not have columns named filter_word_ or filter_bits_.
    """
    h = F.xxhash64(column)
    table = F.broadcast(test.select(F.col("word").alias("filter_word_"), F.col("bits").alias("filter_bits_")))  # WORDS rows at most
    met = df.join(table, F.pmod(h, F.lit(WORDS)) == F.col("filter_word_"), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("filter_bits_"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False)) & column.isNotNull()
    drop = ("filter_word_", "filter_bits_")
    return met.where(hit).drop(*drop), met.where(~hit).drop(*drop)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows of ``docs`` whose doc_id is in ``ids`` (column id).

    The scan of the texts is filtered by ``ids`` first: what is shuffled are the
    texts asked for and few more.
    """
    wanted = stash(ids.select("id").distinct(), "ids", small=True)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return split_by_ids(texts, F.col("id"), wanted)[0].join(wanted, "id", "left_semi")


def stash(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``small`` tables, of ids or links and not of texts, go to a sixteenth of the
    usual number of files.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    _WRITTEN.append((spark, path))
    # The shuffle files of what was written go when the driver's collector finds that nothing refers to them; the scheduler does until its next job.
    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    files = table.inputFiles()
    for spark, path in [x for x in _WRITTEN if files and f"{x[1]}/" in files[0]]:
        delete_path(spark, path)
        _WRITTEN.remove((spark, path))


def mark() -> int:
    """A place in the list of stored tables, for ``release``."""
    return len(_WRITTEN)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete every table that ``stash`` wrote after ``since`` was marked; results that read them must be stored before."""
    files = keep.inputFiles()[:1] if keep is not None else []
    mine, _WRITTEN[since:] = _WRITTEN[since:], []
    for spark, path in mine:
        if any(f"{path}/" in f for f in files):
            _WRITTEN.append((spark, path))
            continue
        try:
            delete_path(spark, path)
        except Exception:  # the session is gone: its folder goes with it
            return


atexit.register(release)
