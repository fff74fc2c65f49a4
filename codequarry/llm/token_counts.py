"""Token counts through a digest cache.

Each text is reduced to a digest of its normalised content and of the
tokenizer's version; digests found in the cache take their stored counts, one
row of each missing digest is encoded, and the new counts are appended.

Null texts are empty (0 tokens).  Repeated rows share one digest and are encoded
once a task that reads them, usually one.  A null or repeated ``doc_id`` keeps its rows.  Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session

CACHE_SCHEMA = "digest string, n_tokens bigint"
#: Words whose counts a worker remembers.
CACHE_WORDS = 1_000_000
#: Digests that a task remembers, so as not to encode repeated rows again.
REMEMBERED = 1_000_000
#: Above this code point, or for these characters, a text goes to the library as a whole.
_LATIN_END = 0x250
_ODD = dict.fromkeys([*range(0x1C, 0x20), 0x85, 0xA0])


class LibraryCounter:
    """Counts of a tokenizer file as its library gives them.

    With ``by_words``, which holds for a tokenizer that splits at white space,
    normalises each character alone and has no other context, Latin texts are
    counted word by word with remembered words; every other text, or one with a
    special string, is encoded whole.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = by_words
        self.words: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        if text.isascii():
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            odd = ord(max(text)) >= _LATIN_END or any(chr(c) in text for c in _ODD)
        return not odd and not any(s in text for s in self.specials)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return self._whole(texts)
        out, whole = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not self._plain(text):
                whole.append(i)
                continue
            words = text.split()
            if missing := list(set(words).difference(self.words)):
                if len(self.words) + len(missing) > CACHE_WORDS:
                    self.words.clear()
                    missing = list(set(words))
                self.words.update(zip(missing, self._whole(missing), strict=True))
            out[i] = sum(map(self.words.__getitem__, words))
        if whole:
            for i, n in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
                out[i] = n
        return out


@lru_cache(maxsize=4)
def counter(path: str, by_words: bool) -> LibraryCounter:
    return LibraryCounter(path, by_words)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file never reads this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def content_digest(text, version: str, fold: bool) -> F.Column:
    """Digest of normalised content and tokenizer version.

    ``fold`` (a tokenizer that lower-cases and drops white space) folds A-Z and
    runs of ASCII white space; a text that may hold a special string stays as it
    is, as those are matched before any folding.
    """
    body = F.coalesce(text.cast("string"), F.lit(""))
    if fold:
        folded = F.concat(F.lit("f"), F.trim(F.translate(F.regexp_replace(body, "[\\x20\\x09-\\x0D]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        body = F.when(F.contains(body, F.lit("<|")), F.concat(F.lit("r"), body)).otherwise(folded)
    return F.concat(F.lit(version + ":"), F.sha2(body.cast("binary"), 256))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, fold: bool, by_words: bool) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs``; new counts are appended to ``cache_path``.

    ``docs`` is read for digests, then for texts.  A missing digest of one row
    is encoded where the row is read; of a missing digest of several rows those
    of the smallest doc_id are brought together and one of them is encoded in
    each task that they reach, usually one.  Texts whose digests are known are
    neither encoded nor shuffled.  The join back to the counts has one
    row a digest on its right side, so copies in any number stay splittable.
    """
    spark = docs.sparkSession
    session.small_batches(spark)
    version = tokenizer_version(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = session.stash(rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), content_digest(F.col("text"), version, fold).alias("digest")), "digests")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).select("digest") if session.path_exists(spark, cache_path) else None
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n"))
    doubtful = missing.where("n > 1").select("digest")
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
        doubtful = doubtful.unionByName(known).distinct()
    # What isn't doubtful is a miss of one row for sure; of the others the misses are looked up by digest, and their texts brought together.
    row = F.coalesce("doc_id", F.lit(0))
    test = session.id_filter(keyed.join(doubtful, "digest", "left_semi").select(row.alias("id")))
    maybe, alone = session.split(rows, row, test)
    looked_up = session.split(keyed, row, test)[0].select("digest").distinct()
    wanted = session.stash(missing.join(looked_up, "digest", "left_semi").select(F.col("digest").alias("id"), "rep_id"), "doubtful-misses")
    few = session.split_by_ids(maybe, row, wanted.select(F.coalesce("rep_id", F.lit(0)).alias("id")))[0].withColumn("digest", content_digest(F.col("text"), version, fold))
    again = few.join(wanted, (F.col("digest") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    alone = alone.withColumn("digest", content_digest(F.col("text"), version, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path, by_words)
        done: set[str] = set()
        for batch in batches:
            texts = {d: t or "" for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d not in done}
            done.update(texts)
            if len(done) > REMEMBERED:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array(c.count(list(texts.values())), pa.int64())], ["digest", "n_tokens"])

    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())])
    new = alone.select("digest", "text").unionByName(again.select("digest", "text")).mapInArrow(run, schema)
    new.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    # Writers at the same time may have stored a digest twice; stored as one row each, the join below can be split where copies crowd.
    counts = session.stash(spark.read.schema(CACHE_SCHEMA).parquet(cache_path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
