"""Embedding near-duplicates by collision-counting projections.

Vectors are put on many one-dimensional projections.  A pair collides on a
projection when the one's value lies in the window centred on the other's; pairs
with enough collisions are verified by their cosine in double precision.  The
window's half width and the count are calibrated: among pairs that are just as
similar as the threshold, a share of ``recall`` must pass.

Counting every pair of a window would be quadratic, so the projections are
sorted in bands: a band's leading projections, cut into windows of a wider
width, gather the vectors whose values lie close on all of them, and collisions
are counted among those.  A pair that shares several bands is counted in its
first one.

Vectors that are null, zero, or have null or non-finite components link with
nothing and are components of their own.  Each length of vectors is compared
apart.  Identical vectors are collapsed first and linked with each
other.  Repeated vec_ids are one vector: links between their rows are dropped.  A
null vec_id never links.  Tables without vectors give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .components import components

#: Rows of a band's cell that are compared with as many others at once.
BLOCK = 1024
#: Unlike vectors that a cell may hold.
CELL = 40


def calibrated(threshold: float, projections: int, recall: float, half_width: float) -> int:
    """Largest count that pairs of cosine ``threshold`` reach with probability ``recall``."""
    gap = sqrt(2 * (1 - threshold))  # distance of unit vectors; a projection of it is normal with this deviation
    p = erf(half_width / gap / sqrt(2))
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def band_keys(x: np.ndarray, bands: int, leading: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key of the cell of each vector in each band: (n, bands)."""
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((x.shape[1], bands * leading))
    shift = rng.random(bands * leading) * width
    cell = np.floor((x @ axes + shift) / width).astype(np.int64).reshape(len(x), bands, leading).astype(np.uint64)
    key = np.zeros((len(x), bands), np.uint64)
    for j in range(leading):
        key = (key ^ (cell[:, :, j] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def banding(n: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """(bands, leading projections a band) for n vectors.

    Unlike vectors share a window of ``width`` with the probability of two
    independent values, so the projections grow with log n until a cell holds
    about ``CELL`` of them; the bands follow from the recall at the threshold.
    """

    def same_window(gap: float) -> float:
        t = width / gap
        return 1 - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2)) - (1 - erf(t / sqrt(2)))

    far, near = same_window(sqrt(2)), same_window(sqrt(2 * (1 - threshold)))
    leading = max(3, ceil(log(max(n / CELL, 1)) / -log(far)))
    return max(1, ceil(log(1 - recall) / log(1 - near**leading))), leading


def window_pairs(group: np.ndarray, lead: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose leading values differ by ``reach`` at most; rows are sorted by (group, lead)."""
    live = np.arange(len(group) - 1)
    step = 1
    while len(live):
        other = live + step
        ok = (group[live] == group[other]) & (lead[other] - lead[live] <= reach)
        live, other = live[ok], other[ok]
        if len(live):
            yield live, other
        step += 1
        live = live[live + step < len(group)]


def verified(i: np.ndarray, j: np.ndarray, x: np.ndarray, p: np.ndarray, half_width: float, count: int, threshold: float) -> np.ndarray:
    """Which pairs collide ``count`` times and have a cosine of the threshold or more."""
    hits = (np.abs(p[i] - p[j]) <= half_width).sum(1) >= count
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(hits)
    out[at] = np.einsum("ij,ij->i", x[i[at]], x[j[at]]) >= threshold
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: as connected as they are, with fewer edges than ids."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            out.append((max(u, v), min(u, v)))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """The sorted rows in frames of about ``most`` rows that end with a group."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch.to_pandas())
        rows += len(held[-1])
        if rows < most:
            continue
        f = pd.concat(held, ignore_index=True)
        last = np.ones(len(f), bool)
        for k in keys:
            last &= (f[k] == f[k].iloc[-1]).to_numpy()
        if not last.all():
            yield f[~last]
        held = [f[last].reset_index(drop=True)]
        rows = len(held[0]) if not last.all() else 0
    if held:
        f = pd.concat(held, ignore_index=True)
        if len(f):
            yield f


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, *, projections: int = 48, half_width: float = 0.45, recall: float = 0.99, width: float = 1.6, reach: float = 1.2, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Each vector travels once a band, in blocks: a cell of more than BLOCK
    vectors is split into pairs of blocks, so a third of all vectors in one
    cell spread over many tasks.  What leaves a task is counts a vector and
    spanning forests, not the pairs.
    """
    spark = vectors.sparkSession
    session.small_batches(spark)
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("e"))
    finite = F.expr("vec_id is not null and e is not null and size(e) > 0 and forall(e, t -> t is not null and not isnan(t) and abs(t) < double('Infinity')) and exists(e, t -> t <> 0)")
    good = v.where(finite)
    ids = v.select("vec_id")
    # Vectors of unlike lengths have no cosine; a length that only one row has links with nothing.
    lengths = sorted(r["d"] for r in good.groupBy(F.size("e").alias("d")).count().where("count > 1").collect())
    if not lengths:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64

    def of_length(dim: int) -> tuple[DataFrame, DataFrame]:
        """Members of the groups of identical vectors, and links and forests between the groups."""
        keyed = good.where(F.size("e") == dim).withColumn("same", F.xxhash64("e")).groupBy("vec_id", "same", "e").agg(F.lit(1).alias("one")).drop("one")
        groups = session.stash(keyed.groupBy("same", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
        member = session.stash(keyed.join(groups, ["same", "e"]).select("vec_id", "rep", "copies"), "vector-members")
        bands, leading = banding(groups.count(), threshold, width, recall)
        count = calibrated(threshold, projections, 0.999, half_width)
        axes = np.random.default_rng(seed + 1).standard_normal((dim, projections))

        def unit(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, dim)
                keys = band_keys(unit(x), bands, leading, width, seed)
                raw, all_keys = np.array([r.tobytes() for r in x], object), np.array([k.tobytes() for k in keys], object)
                for a in range(bands):  # a batch a band: no more rows at once than came in
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, a, np.int32)), pa.array(keys[:, a]), batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(all_keys, pa.binary())],
                        ["band", "cell", "rep", "copies", "x", "keys"],
                    )

        schema = T.StructType([T.StructField(n, t) for n, t in (("band", T.IntegerType()), ("cell", T.LongType()), ("rep", T.LongType()), ("copies", T.LongType()), ("x", T.BinaryType()), ("keys", T.BinaryType()))])
        rows = groups.select("rep", "e", "copies").mapInArrow(spread, schema)
        crowded = rows.groupBy("band", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        crowded = session.stash(crowded.select("band", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded-cells")
        rows = rows.join(crowded, ["band", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
        # Every vector meets each block of its cell, as a row of the lower or of the higher of the two.
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("band", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "copies", "x", "keys")
        group = ["band", "cell", "lo", "hi"]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in whole_groups(batches, group, 4096):
                x = unit(np.frombuffer(b"".join(f["x"]), kind).reshape(-1, dim))
                p = x @ axes
                g = f.groupby(group, sort=False).ngroup().to_numpy()
                order = np.lexsort((p[:, 0], g))
                g, x, p = g[order], x[order], p[order]
                rep, copies, block = (f[c].to_numpy()[order] for c in ("rep", "copies", "block"))
                band, cross = f["band"].to_numpy()[order], (f["lo"] != f["hi"]).to_numpy()[order]
                k = np.frombuffer(b"".join(f["keys"]), np.int64).reshape(-1, bands)[order]
                earlier = np.arange(bands)[None, :] < band[:, None]
                links = np.zeros(len(rep), np.int64)
                ends: list[tuple[np.ndarray, np.ndarray]] = []
                for i, j in window_pairs(g, p[:, 0], reach):
                    ok = ~cross[i] | (block[i] != block[j])
                    i, j = i[ok], j[ok]
                    ok = verified(i, j, x, p, half_width, count, threshold)
                    i, j = i[ok], j[ok]
                    fresh = ~((k[i] == k[j]) & earlier[i]).any(1)  # not met in an earlier band
                    i, j = i[fresh], j[fresh]
                    if len(i):
                        np.add.at(links, i, copies[j])
                        np.add.at(links, j, copies[i])
                        ends.append((rep[i], rep[j]))
                some = np.flatnonzero(links)
                tree = forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])) if ends else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[some].tolist() + [t[0] for t in tree], pa.int64()), pa.array([None] * len(some) + [t[1] for t in tree], pa.int64()), pa.array(links[some].tolist() + [0] * len(tree), pa.int64())],
                    ["a", "b", "links"],
                )

        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = rows.repartition(parts, *group).sortWithinPartitions(*group)
        found = session.stash(dealt.mapInArrow(compare, "a bigint, b bigint, links bigint"), "vector-links")
        return member.withColumn("d", F.lit(dim)), found.withColumn("d", F.lit(dim))

    member, found = (functools.reduce(DataFrame.unionByName, parts) for parts in zip(*map(of_length, lengths), strict=True))
    links = found.where("b is null").groupBy("d", F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    same = components(found.where("b is not null").select("a", "b").unionByName(member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    by_vector = member.join(links, ["d", "rep"], "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.join(by_vector, "vec_id", "left").join(same.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
