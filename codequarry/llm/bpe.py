"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap; each chunk is pre-tokenised alone, the
boundary lists are stitched at a boundary on which both neighbours agree, and
each pre-token is encoded by its ranks.  Decoding joins the tokens' raw bytes.
Very long texts are dealt to many tasks in segments that meet the same way.

Nulls and empty texts have no tokens.  Repeated rows give repeated results, a
null ``doc_id`` stays null, other columns are not read.  A text without any
common boundary in an overlap (one enormous run of letters) is continued from
the last sure boundary, so the result never depends on the chunk size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .textcore import trim

#: Longest look-ahead, in characters, that a match ending before a chunk's end may have needed.
GUARD = 4


def chunk_boundaries(pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of ``text[start:stop]``, as offsets in ``text``."""
    return [start + m.end() for m in pattern.finditer(text[start:stop])]


def stitched_boundaries(pattern, text: str, chunk: int, overlap: int) -> list[int]:
    """Ends of all pre-tokens of ``text``, from chunks pre-tokenised alone.

    Matching from a boundary depends only on what follows it, so from a common
    boundary on the later chunk's list is the text's own.
    """
    n = len(text)
    if n <= chunk:
        return chunk_boundaries(pattern, text, 0, n)
    sure: list[int] = []
    begin = 0
    ends = chunk_boundaries(pattern, text, 0, min(chunk, n))
    stop = min(chunk, n)
    while stop < n:
        good = [e for e in ends if e <= stop - GUARD]
        nxt = max(begin + 1, stop - overlap)
        far = min(nxt + chunk, n)
        after = chunk_boundaries(pattern, text, nxt, far)
        known = set(after)
        meet = next((e for e in good if e >= nxt and e in known), None)
        if meet is None:  # no agreement in the overlap: go on from the last sure boundary
            sure += good
            nxt = good[-1] if good else begin
            far = min(max(nxt + chunk, stop + chunk), n)
            after = chunk_boundaries(pattern, text, nxt, far)
        else:
            sure += [e for e in good if e <= meet]
            after = [e for e in after if e > meet]
            nxt = meet
        begin, ends, stop = nxt, after, far
    return sure + ends


class Codec:
    """Ranks of one vocabulary: encodes pre-tokens, decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.pattern = regex.compile(pattern)
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self._bytes[i] = token

    def encode(self, text: str, chunk: int, overlap: int) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A stretch between two boundaries is encoded as it would be inside the
        text if it doesn't end with white space, the only thing for which the
        pattern looks ahead.
        """
        if len(text) <= chunk:
            ids = self._core.encode_ordinary(text)
        else:
            ends = stitched_boundaries(self.pattern, text, chunk, overlap)
            cuts, last = [0], 0
            for e in ends:
                if e - last >= chunk and not text[e - 1].isspace():
                    cuts.append(last := e)
            cuts.append(len(text))
            ids = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self._core.encode_ordinary(text[a:b])]
        return np.asarray(ids, dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def result_fields(keep_ids: bool) -> list[T.StructField]:
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return fields + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if keep_ids else [])


def result_batch(first: list[pa.Array], counts: list[int], ids_sha: list[str], decoded_sha: list[str], kept: list[bytes] | None, names: list[str]) -> pa.RecordBatch:
    cols = [*first, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
    if kept is not None:
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        cols.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(kept), dtype="<i4"))))
    return pa.RecordBatch.from_arrays(cols, names)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = 1 << 12, overlap: int = 1 << 8, segment: int = 1 << 16, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) of every text.

    Texts are cut into chunks of ``chunk`` characters.  Those of up to
    ``segment`` characters are encoded where they are read, without a shuffle;
    longer ones are dealt out in segments, so that many tasks share one text.
    """
    if not 0 < overlap < chunk <= segment:
        raise ValueError("overlap must be positive and below chunk, and chunk no longer than segment")
    fields = result_fields(keep_ids)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            trim()
            counts, a, b, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "", chunk, overlap)
                counts.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            yield result_batch([batch.column(0)], counts, a, b, kept if keep_ids else None, names)

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    long = F.coalesce(F.length("text"), F.lit(0)) > segment
    short = rows.where(~long).mapInArrow(run, T.StructType(fields))
    # Repeated rows are one job; its number is stored with its text.
    jobs = session.stash(rows.where(long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("job", F.monotonically_increasing_id()), "long-texts")
    if jobs.isEmpty():
        return short
    encoded, left = in_segments(jobs.select("job", "text"), ranks_path, pattern, chunk, overlap, segment, keep_ids)
    encoded = encoded.join(jobs.select("job", "doc_id", "copies"), "job")
    rest = jobs.join(left, "job", "left_semi").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy").mapInArrow(run, T.StructType(fields))
    return short.unionByName(encoded.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")).unionByName(rest)


def in_segments(jobs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, segment: int, keep_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Results of the ``jobs`` (job, text), and the jobs whose segments don't meet.

    Each segment and the overlap behind it is pre-tokenised alone.  Neighbours
    meet at the first boundary in their overlap that both have; what lies
    between two meeting points is encoded by itself, and the results of a text
    are put together in order, as a stream.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = -(-len(text) // segment)
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([job]), pa.array([k], pa.int32()), pa.array([k == n - 1]), pa.array([text[k * segment : (k + 1) * segment + overlap]])], ["job", "k", "last", "piece"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            head, tail = [], []
            for k, piece in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # Only where no white space is behind: nothing before a boundary depends on what follows it then.
                ends = [e for e in stitched_boundaries(c.pattern, piece, chunk, overlap) if not piece[e - 1].isspace()]
                head.append([k * segment + e for e in ends if e <= overlap])
                tail.append([k * segment + e for e in ends if segment < e <= len(piece) - GUARD])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["job", "k", "last", "piece", "head", "tail"])

    pieces = jobs.mapInArrow(deal, "job bigint, k int, last boolean, piece string").repartition("job", "k")
    pieces = session.stash(pieces.mapInArrow(pre_tokenise, "job bigint, k int, last boolean, piece string, head array<bigint>, tail array<bigint>"), "segments")
    ahead = pieces.select("job", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    met = session.stash(pieces.where("not last").select("job", "k", "tail").join(ahead, ["job", "k"]).select("job", "k", F.array_min(F.array_intersect("tail", "next")).alias("at")), "meeting-points", small=True)
    left = met.where("at is null").select("job").distinct()
    parts = pieces.select("job", "k", "piece").join(left, "job", "left_anti")
    parts = parts.join(met.select("job", (F.col("k") + 1).alias("k"), F.col("at").alias("from")), ["job", "k"], "left").join(met.select("job", "k", F.col("at").alias("to")), ["job", "k"], "left")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            ids = []
            for k, piece, a, b in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
                start = k * segment
                ids.append(c.encode(piece[(a or start) - start : None if b is None else b - start], chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["job", "k", "ids"])

    ids = parts.select("job", "k", "piece", "from", "to").mapInArrow(encode, "job bigint, k int, ids binary")
    fields = [T.StructField("job", T.LongType()), *result_fields(keep_ids)[1:]]
    names = [f.name for f in fields]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        now, n, one, two, kept = None, 0, hashlib.sha256(), hashlib.sha256(), []

        def done() -> pa.RecordBatch:
            return result_batch([pa.array([now], pa.int64())], [n], [one.hexdigest()], [two.hexdigest()], kept if keep_ids else None, names)

        for batch in batches:
            for job, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if job != now:
                    if now is not None:
                        yield done()
                    now, n, one, two, kept = job, 0, hashlib.sha256(), hashlib.sha256(), []
                n += len(part) // 4
                one.update(part)
                two.update(c.decode(part))
                if keep_ids:
                    kept.append(part)
        if now is not None:
            yield done()

    return ids.repartition("job").sortWithinPartitions("job", "k").mapInArrow(gather, T.StructType(fields)), left
