"""Near-duplicate documents: an exact Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles, as 64-bit hashes, in the
order (common ones last, hash).  If two sets are similar enough, the l-prefix of
each, its first ``size - ceil(t size) + l`` elements, holds at least l elements of
the other.  Every document starts with l = 1; for each element whose estimated
candidate cost is too high its prefix is lengthened by one and one more match is
required, so that the costly element alone no longer makes a candidate.

Equal sets are one class, joined through their smallest doc_id.  Prefix elements
that the same documents hold are bundled, so a pair meets once a bundle and not
once an element.  A first round verifies each class against one leader of its
prefix elements and so gathers large groups of near copies as stars; the second
round pairs what lies outside a bundle's largest component with the bundle, so
what it emits doesn't grow with the square of a group of copies.  Links between
different sets are all found, in the sense that components are exact.

Null texts, empty texts and texts without words have empty sets and link with
nothing.  Rows with one doc_id are one document.  A null doc_id is kept and links
with nothing.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .components import components
from .textcore import mix, shingle_rows

#: A shingle that a larger share of all documents holds, but COMMON_LEAST of them at least, is common.
COMMON_SHARE = 1 / 4096
COMMON_LEAST = 32
#: Elements whose counts a task holds at once, in about two documents a share or more.
COUNTED = 2_000_000
#: Components that an element's bundle may lead to before it counts as costly.
COSTLY = 32
#: Words of 64 bits of a set's parity bitmap: sets differ in at least as many elements as their bitmaps in bits.
PARITY = 4
#: How far a prefix may be lengthened.
LENGTHEN = 12
FLIPS = [f"p{i}" for i in range(PARITY)]
#: Sets that a task remembers, to leave out the prefixes of their copies.
REMEMBERED = 1_000_000
#: Rows of counts of common elements that are sent to every task; more are joined by a shuffle.
BROADCAST = 1_000_000


def required(size: int, percent: int) -> int:
    """Least overlap of a set with any set as similar as ``percent``: ceil(t size)."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int, matches: int = 1) -> int:
    return min(size, size - required(size, percent) + matches)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold.

    Tasks count their documents in stretches and name what they met three times
    or more; the named counts are summed.  What is in a large share of all
    documents is in as large a share of some stretch, so it is named.  At most
    (mean set size) * 2 / COMMON_SHARE shingles can pass, whatever the corpus, so
    the list may be sent to every task.  It orders elements and decides nothing
    else: what it lacks costs time, not links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, sh, _ in shingle_rows(batch.column(0)):
                held.append(np.unique(sh))
                size += len(held[-1])
            if size >= COUNTED:
                yield named_counts(held, rows)
                held, size, rows = [], 0, 0
        yield named_counts(held, rows)

    def named_counts(held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        v = np.concatenate([np.zeros(0, np.uint64), *held])
        held.clear()
        v.sort()
        first = np.flatnonzero(np.concatenate([[len(v) > 0], v[1:] != v[:-1]])[: len(v)])
        n = np.diff(np.append(first, len(v)))
        often = n >= max(3, rows * COMMON_SHARE / 2)
        h = [*v[first[often]].astype(np.int64).tolist(), None]
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([*n[often].tolist(), rows], pa.int64())], ["h", "n"])

    named = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    named = session.stash(named, "named-shingles", small=True)
    total = named.where("h is null").select(F.sum("n")).collect()[0][0] or 0
    rows = named.where(F.col("h").isNotNull() & (F.col("n") >= max(COMMON_LEAST, total * COMMON_SHARE / 2))).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().astype(np.int64).view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def ordered(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct hashes, the common ones after the others, each part by hash; how many are not common."""
    s = np.unique(values)
    if not len(common) or not len(s):
        return s, len(s)
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = common[at] == s
    return np.concatenate([s[~late], s[late]]), len(s) - int(late.sum())


def parity(values: np.ndarray) -> np.ndarray:
    """PARITY words in which each element of the set flips one bit."""
    at = (mix(values) >> np.uint64(32)).astype(np.int64) % (64 * PARITY)
    bits = np.bincount(at, minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its parity bitmap, how many elements aren't common, and its prefix with LENGTHEN spare elements.

    Of equal sets that one task reads only the first has a prefix, so a group of
    copies makes as many as there are tasks and not documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            sizes, digests, parts, flips, rare = [], [], [], [], []
            ids = batch.column(0).is_valid().to_pylist()
            for (_, sh, _), named in zip(shingle_rows(batch.column(1)), ids, strict=True):
                s, n = ordered(sh, shared.value)
                sizes.append(len(s))
                rare.append(n)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                digests.append(digest)
                flips.append(parity(s))
                parts.append(None if digest in met or not named else s[: prefix_length(len(s), percent, 1 + LENGTHEN)].astype(np.int64))
                if named:
                    met.add(digest)
            if len(met) > REMEMBERED:
                met.clear()
            ends = pa.array(np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts])]).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(p for p in parts if p is not None)]))
            words = np.stack(flips, 1) if flips else np.zeros((PARITY, 0), np.int64)
            lists = pa.ListArray.from_arrays(ends, flat, mask=pa.array([p is None for p in parts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(w) for w in words), pa.array(rare, pa.int32()), lists], names)

    names = ["doc_id", "n_shingles", "digest", *FLIPS, "rare", "prefix"]
    schema = "doc_id bigint, n_shingles bigint, digest binary, " + "".join(f"{f} bigint, " for f in FLIPS) + "rare int, prefix array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets reach ``percent``.

    Only texts of documents in pairs are shuffled.  A leader's text travels once a
    pair; its set is remembered while its pairs follow each other.
    """
    texts = session.texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = texts.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a")
    right = texts.withColumnRenamed("id", "b").withColumnRenamed("text", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def sets(column: pa.Array) -> list[np.ndarray]:
            out: list[np.ndarray | None] = []
            new, where = [], []
            for i, t in enumerate(column.to_pylist()):
                key = hashlib.blake2b((t or "").encode(), digest_size=12).digest()
                out.append(known.get(key))
                if out[-1] is None:
                    new.append(t)
                    where.append((i, key))
            for (i, key), (_, sh, _) in zip(where, shingle_rows(pa.array(new, pa.string())), strict=True):
                out[i] = known[key] = np.unique(sh)
            if sum(map(len, known.values())) > 2_000_000:
                known.clear()
            return out

        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def shared_elements(posts: DataFrame, bound: int) -> DataFrame:
    """``posts`` (doc_id, pos, h, late) with the leader and the bundle of each element that two documents hold.

    Elements held by the same documents are one bundle; those held by many are
    bundled by the document of least hash among their holders, which elements of
    one passage mostly share.  So what a pair of documents has in common meets in
    a few bundles instead of once an element.

    Common elements, at most ``bound``, are counted by a pre-aggregation and
    looked up, so no task gathers the documents of one of them; what is left is
    held by too small a share of the documents to crowd a task.
    """
    held = [F.min("doc_id"), F.max("doc_id"), F.count("*"), F.bit_xor(F.xxhash64("doc_id")), F.min(F.xxhash64("doc_id", F.lit(3)))]
    names = ["leader", "last", "holders", "all_", "least_"]
    rare = posts.where("not late")
    for name, x in zip(names, held, strict=True):
        rare = rare.withColumn(name, x.over(W.partitionBy("h")))
    late = posts.where("late")
    counts = late.groupBy("h").agg(*[x.alias(n) for n, x in zip(names, held, strict=True)]).where("last > leader")
    late = late.join(F.broadcast(counts) if bound <= BROADCAST else counts, "h")
    found = rare.where("last > leader").unionByName(late.select(*rare.columns))
    bundle = F.when(F.col("holders") <= COSTLY, F.xxhash64("all_", "holders")).otherwise(F.xxhash64("least_"))
    return found.select("doc_id", "pos", "leader", bundle.alias("bundle"))


def candidate_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb, met): pairs of documents of different components with as many matches as they must have.

    A bundle's main component, which may be a huge group of copies, is never
    paired with itself: each other document meets all documents of the bundle.
    """
    carried = ["doc_id", "low", "high", "component", "n", "low_at", "high_at", "sets", "matches", "stuck", "dear", "main", *FLIPS]
    x = open_.where("not main").select("bundle", "costly", *[F.col(c).alias(f"{c}_a") for c in carried])
    y = open_.select("bundle", "costly", *[F.col(c).alias(f"{c}_b") for c in carried])
    once = F.expr("main_b or doc_id_a > doc_id_b")
    cheap = x.where("not costly").join(y.where("not costly").drop("costly"), "bundle").where(once)
    # A costly element is passed over, except for those that could not lengthen their prefix.
    y = y.where("costly").drop("costly")
    dear = x.where("costly and stuck_a").join(y, "bundle").where(F.expr("not main_b and not stuck_b") | once)
    dear = dear.unionByName(x.where("costly and not stuck_a").join(y.where("main_b and stuck_b"), "bundle"))
    least = lambda n: F.expr(f"(({percent} * {n}) + 99) div 100")
    need = F.expr(f"({percent} * (low_a + low_b) + {99 + percent}) div {100 + percent}")
    fits = (F.col("high_a") >= least("low_b")) & (F.col("high_b") >= least("low_a"))
    # Matches before a bundle's first are bounded by the positions, those from there on by what is left.
    reach = F.least(F.col("low_a") - F.col("low_at_a"), F.col("low_b") - F.col("low_at_b")) + F.least("high_at_a", "high_at_b")
    # The sets differ in at least as many elements as their bitmaps do in bits.
    differ = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in FLIPS), F.lit(0))
    several = F.greatest("sets_a", "sets_b") > 1
    pairs = cheap.unionByName(dear).where("component_a <> component_b").where(fits)
    pairs = pairs.where(several | ((reach >= need) & (F.col("low_a") + F.col("low_b") - differ >= 2 * need)))
    # Of the required matches as many may be costly elements as both sides passed over.
    wanted = F.when(several, 1).otherwise(F.least("matches_a", "matches_b") - F.least("dear_a", "dear_b"))
    higher = F.col("doc_id_a") > F.col("doc_id_b")
    ends = [F.when(higher, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(n) for c, n in (("doc_id", "a"), ("component", "ca"))]
    ends += [F.when(higher, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(n) for c, n in (("doc_id", "b"), ("component", "cb"))]
    met = pairs.select(*ends, F.least("n_a", "n_b").alias("n"), wanted.alias("wanted")).groupBy("a", "b", "ca", "cb").agg(F.sum("n").alias("met"), F.min("wanted").alias("wanted"))
    return met.where("met >= wanted").drop("wanted")


def similar_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of ``percent`` and more) of each row of ``docs``."""
    spark = docs.sparkSession
    session.small_batches(spark)
    common = common_shingles(docs)
    prefixes = session.stash(signatures(docs, percent, common), "prefixes")
    signed = session.stash(prefixes.select("doc_id", "n_shingles", "digest", *FLIPS, F.col("prefix").isNotNull().alias("first")), "signatures")
    some = signed.where("doc_id is not null and n_shingles > 0")
    base = F.expr(f"cast(n_shingles - ((({percent} * n_shingles) + 99) div 100) + 1 as int)")
    member = session.stash(some.groupBy("doc_id", "n_shingles", "digest", *FLIPS).agg(F.max("first").alias("first")), "set-members")
    classes = session.stash(member.groupBy("n_shingles", "digest").agg(F.min(F.when(F.col("first"), F.col("doc_id"))).alias("rep")), "set-classes", small=True)
    placed = member.join(classes, ["n_shingles", "digest"])
    # A document of several sets, from rows with one id, is filtered by the range of their sizes.
    per = placed.groupBy("doc_id").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max(base).alias("base"), F.count("*").alias("sets"), F.min("rep").alias("rep"), *[F.min(f).alias(f) for f in FLIPS])
    per = per.where("doc_id = rep or sets > 1").drop("rep")

    # Only elements that two documents hold can make a pair.  Copies of a class go; a leader is never one, as its class has a smaller id.
    posts = prefixes.where("doc_id is not null and prefix is not null").select("doc_id", "rare", F.posexplode("prefix").alias("pos", "h")).select("doc_id", "pos", "h", (F.col("pos") >= F.col("rare")).alias("late"))
    bundles = shared_elements(posts, len(common)).repartition("doc_id").groupBy("doc_id", "bundle").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.min("leader").alias("leader"))
    bundles = session.stash(bundles.join(per, "doc_id"), "bundles")
    session.drop(prefixes)

    # Round one: each class against the leader that most of its elements name.
    # Near copies share most of a prefix; a few shared elements are left to round two.
    within = lambda end: F.size(F.filter("at", lambda p: p < end))
    votes = bundles.where("doc_id <> leader").groupBy("doc_id", "leader", "base").agg(F.sum(within(F.col("base"))).alias("count")).where("10 * count >= 3 * base")
    star = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("count"), "leader")).alias("m")).select(F.col("doc_id").alias("a"), F.col("m.leader").alias("b"))
    first = session.stash(verify(star, docs, percent), "first-links")
    joined = components(first)

    # Round two: bundles that still lead from one component to others.
    placed = bundles.drop("leader").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    cost = placed.groupBy("bundle", "component").agg(F.count("*").alias("docs")).groupBy("bundle").agg(F.count("*").alias("cost"), F.min(F.struct(-F.col("docs"), "component")).alias("m")).where("cost > 1")
    cost = cost.select("bundle", "cost", F.col("m.component").alias("largest"))
    open_ = session.stash(placed.join(cost, "bundle"), "open-bundles")
    costly = F.col("cost") > COSTLY
    # The more candidates a prefix leads to, the further it is lengthened, and always past its costly elements;
    # a document that can't be passes over none of them.
    open_ = open_.withColumn("spare", F.least(F.col("low") - F.col("base") + 1, F.lit(1 + LENGTHEN)).cast("int"))
    price = F.sum(within(F.col("base")) * (F.least("cost", F.lit(COSTLY)) - 1))
    per_doc = open_.groupBy("doc_id").agg(F.sum(F.when(costly, within(F.col("base") + F.col("spare") - 1)).otherwise(0)).alias("dear"), price.alias("price"))
    open_ = open_.join(per_doc, "doc_id")
    can = (F.col("dear") < F.col("spare")) & (F.col("sets") == 1)
    asked = F.least(F.col("spare"), F.greatest(F.col("dear") + 1, 1 + F.floor(F.log2(1 + F.col("price"))).cast("int")))
    open_ = open_.withColumn("stuck", ~can).withColumn("matches", F.when(F.col("sets") > 1, 1).otherwise(asked))
    open_ = open_.withColumn("at", F.filter("at", lambda p: p < F.col("base") + F.col("matches") - 1)).where(F.size("at") > 0)
    open_ = open_.select("bundle", "doc_id", "low", "high", "component", F.size("at").alias("n"), F.element_at("at", 1).alias("low_at"), F.element_at("at", -1).alias("high_at"), "sets", "matches", "stuck", F.when(can, F.col("dear")).otherwise(0).alias("dear"), (F.col("component") == F.col("largest")).alias("main"), costly.alias("costly"), *FLIPS)
    open_ = session.stash(open_, "lengthened-prefixes")
    pairs = session.stash(candidate_pairs(open_, percent).join(first, ["a", "b"], "left_anti"), "candidates")
    # Of two components the most promising pair first; where it links them, the others needn't be looked at.
    best = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("met", "a", "b")).alias("m")).select("m.a", "m.b")
    best = session.stash(best, "best-candidates", small=True)
    second = session.stash(verify(best, docs, percent), "second-links")
    name = components(first.unionByName(second)).withColumnRenamed("component", "c")
    rest = pairs.join(best, ["a", "b"], "left_anti")
    for side, old in (("a", "ca"), ("b", "cb")):
        rest = rest.join(name.select(F.col("id").alias(side), F.col("c").alias(f"new_{side}")), side, "left").withColumn(old, F.coalesce(f"new_{side}", old))
    third = session.stash(verify(session.stash(rest.where("ca <> cb").select("a", "b"), "other-candidates", small=True), docs, percent), "third-links")

    copies = member.join(classes, ["n_shingles", "digest"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = components(first.unionByName(second).unionByName(third).unionByName(copies)).withColumnRenamed("id", "doc_id")
    return signed.select("doc_id", "n_shingles").join(same, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
