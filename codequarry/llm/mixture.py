"""Mixing sources to target weights by Sainte-Laguë apportionment.

All tokens of the mix are dealt as equal blocks: sources get blocks by the
highest quotients ``weight / (2 s + 1)``, a source's blocks go to its shards by
the same rule, and each shard takes its quota of blocks in a seeded order of its
documents.  A shard is a hash class of a source's documents, so the largest
source spreads over as many tasks as it needs.

Null sources form one source of their own, last in order.  Null and empty texts
have size 0 and take nothing.  Repeated rows are separate rows of the mix; ties
of the seeded order, a hash of doc_id and text, are broken by doc_id, then size.  An empty table gives an
empty mix.  ``mix`` doesn't read columns other than doc_id, source and text;
``mixed_documents`` carries them along, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import session

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights name their sources one by one, so the sources of a mix are a list on the driver; more are refused, not dropped.
MAX_SOURCES = 1_000_000
#: Shards of a source: beyond shard_tokens times as many tokens they grow instead.
MAX_SHARDS = 1 << 16
#: Rows of shards that are sent to every task; more are joined by a shuffle.
BROADCAST = 1_000_000


def water_fill(weights: Sequence[float], limits: Sequence[float], total: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at its limit and the excess goes to the others by weight."""
    share, open_ = [0.0] * len(weights), list(range(len(weights)))
    rest = float(total)
    while open_:
        scale = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * scale >= limits[i]]
        if not full:
            for i in open_:
                share[i] = weights[i] * scale
            break
        for i in full:
            share[i] = float(limits[i])
            rest -= share[i]
        open_ = [i for i in open_ if i not in set(full)]
    return share


def sainte_lague(weights: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients w/(2s+1); ties go to the earlier entry, nobody passes its limit.

    Starts from the seats that every such allotment has for sure, so the work
    is in the number of entries and not of seats.
    """
    w = np.asarray(weights, dtype=float)
    cap = np.full(len(w), seats) if limits is None else np.asarray(limits, dtype=np.int64)
    seats = int(min(seats, cap[w > 0].sum()))
    if not len(w) or seats <= 0:
        return [0] * len(w)
    low, high = 0.0, 2.0 * seats / w[w > 0].min() + 2
    taken = lambda d: np.minimum(np.floor(w * d / 2 + 0.5), cap).astype(np.int64)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid).sum() <= seats else (low, mid)
    got = taken(low)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if w[i] > 0 and got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def word_count(text) -> F.Column:
    """Number of words: a text's words reduced to one mark each, the rest removed."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD, "\u0001")
    return F.length(F.regexp_replace(marks, "[\\x20\\x09-\\x0D]+", "")).cast("bigint")


def shares(spark, totals: DataFrame, weights: Sequence[float], share: float, most: int, block: int, shard_tokens: int) -> tuple[DataFrame, int]:
    """One row a source (k, source_, source_size, target, seats, shards), and the size of a block.

    ``totals`` has source and source_size.
    """
    listed = totals.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give them as fewer groups")
    listed.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [int(r.source_size) for r in listed]
    by_source = [float(weights[i % len(weights)]) for i in range(len(listed))]
    targets = water_fill(by_source, [most * s for s in sizes], share * sum(sizes))
    shards = [max(1, min(MAX_SHARDS, -(-s // shard_tokens))) for s in sizes]
    # Blocks of one size for all sources, so that a seat is worth the same everywhere; sources without words have none.
    unit = max(1, min([min(block, s // 64) for s in sizes if s], default=block))
    seats = sainte_lague(targets, round(sum(targets) / unit), [most * -(-s // unit) for s in sizes])
    frame = pd.DataFrame({"k": range(len(listed)), "source_": [r.source for r in listed], "source_size": sizes, "target": targets, "seats": seats, "shards": shards})
    return spark.createDataFrame(frame, "k int, source_ string, source_size bigint, target double, seats bigint, shards int"), unit


def order_of(doc_id, text, seed: int) -> F.Column:
    """The seeded place of a row in its shard's order; rows of one place have one id and text."""
    return F.xxhash64(F.lit(seed), doc_id.cast("bigint"), text.cast("string"))


def shard_of(order, shards, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), order), shards).cast("int")


def dealt(docs: DataFrame, weights: Sequence[float], share: float, most: int, block: int, shard_tokens: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, size, o, and what their source, shard and place give), and the plan of the sources."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order_of(F.col("doc_id"), F.col("text"), seed).alias("o"))
    sized = session.stash(sized, "sizes")
    plan, unit = shares(spark, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, block, shard_tokens)
    placed = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")  # MAX_SOURCES rows at most
    placed = placed.withColumn("shard", shard_of(F.col("o"), F.col("shards"), seed))
    per_shard = placed.groupBy("k", "shard").agg(F.sum("size").alias("tokens"), F.first("seats").alias("seats"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        limits = [most * -(-int(t) // unit) for t in pdf["tokens"]]
        return pdf.assign(quota=sainte_lague(pdf["tokens"].tolist(), int(pdf["seats"].iloc[0]), limits))[["k", "shard", "tokens", "quota"]]

    # At most MAX_SHARDS rows a source.
    quotas = per_shard.groupBy("k").applyInPandas(deal, "k int, shard int, tokens bigint, quota bigint")
    before = W.partitionBy("k", "shard").orderBy("o", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    run = placed.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))).join(quotas, ["k", "shard"])
    blocks = F.greatest(F.lit(1), F.expr(f"(tokens + {unit - 1}) div {unit}"))
    run = run.withColumn("blocks", blocks).withColumn("full", F.expr("quota div blocks")).withColumn("edge", F.expr("quota % blocks") * unit)
    return run, plan


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, *, most: int = 2, block: int = 256, shard_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, starts of each row of ``docs``.

    ``weights`` repeat over the sources in code point order.  ``taken`` counts
    the row's tokens in the selected blocks, at most ``most`` times each;
    ``starts`` is how often its first token was selected, which says how many
    whole copies a mix of documents holds.

    Texts are read once, for their sizes and places; what is shuffled is (doc, size, place) only.
    """
    run, _ = dealt(docs, weights, share, most, block, shard_tokens, seed)
    part = F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), F.col("edge")) - F.col("begin"))
    return run.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("full") * F.col("size") + part).cast("bigint").alias("taken"),
        F.when(F.col("size") == 0, 0).otherwise(F.col("full") + (F.col("begin") < F.col("edge")).cast("int")).cast("int").alias("starts"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, *, most: int = 2, block: int = 256, shard_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as the mix holds them: each as often as its first token was selected, in all its columns.

    A row without words is kept once: it weighs nothing.  Of rows with one id
    and text that the edge of the selection cuts through, all are taken as
    often as the first.

    Each shard has one row that says how often all of it is taken and up to
    which place once more, so no text is shuffled while there are up to
    BROADCAST shards.
    """
    run, plan = dealt(docs, weights, share, most, block, shard_tokens, seed)
    inside = F.max(F.when((F.col("begin") < F.col("edge")) & (F.col("size") > 0), F.col("o")))
    cut = session.stash(run.groupBy("k", "shard").agg(F.first("full").alias("full"), inside.alias("last")), "shard-cuts", small=True)
    small = cut.count() <= BROADCAST
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order_of(F.col("doc_id"), F.col("text"), seed).alias("o"))
    rows = rows.join(F.broadcast(plan.select("k", "source_", "shards")), F.col("source").eqNullSafe(F.col("source_")), "left")
    rows = rows.withColumn("shard", shard_of(F.col("o"), F.col("shards"), seed)).join(F.broadcast(cut) if small else cut, ["k", "shard"], "left")
    copies = F.when(F.col("size") == 0, 1).otherwise((F.col("full") + F.coalesce(F.col("o") <= F.col("last"), F.lit(False)).cast("int")).cast("int"))
    return rows.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
