"""Near-duplicate passages by compact windows.

The elements of a text are its five-word shingles.  Under one hash function the
element of least hash owns its compact window: the largest interval in which it
stays the least, which is a node of the Cartesian tree over the hashes.  All
subsequences of a window that hold its owner share that min-hash, so texts with
a common passage have windows with a common owner under most functions.  Only
nodes at least as wide as the shortest passage matter; they are the minima of
the sliding windows of that width, and the tree is built over those alone.

Windows with a common owner are grouped by the words on the owner's left and on
its right and joined to the first document of their group, so a passage in s
documents makes s - 1 links.  For each pair of documents the linked intervals
are joined; where the windows of enough functions overlap, the passages are
verified on the texts: ``MIN_WORDS`` words or more, Jaccard similarity of the
shingles ``percent`` or more.

The first document of a group may hold less than the passage that later ones
share.  Members whose surroundings no verified passage covers are therefore led
again, by the first document that has the same ``MIN_WORDS`` words around the
owner: every run of that length has its own group, of which all members share a
passage, so none that is repeated word for word depends on a leader.  One
function is enough for that, as all texts with the run have the same owner in it.

The first document, by id, keeps a passage.  Texts that are null, empty or
shorter than the shortest passage have none.  Passages repeated inside one
document only are not reported.  Rows that share a doc_id are one document, of
which the texts in their order by digest are looked at in turn; a null doc_id
takes no part.  Other columns are carried by ``without_repeats`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .textcore import SHINGLE_WORDS, mix, row_ids, shingles, slices, text_buffer, word_hashes, word_spans

MIN_WORDS = 50
FUNCTIONS = 5
#: Functions whose windows must overlap before a pair is verified: two of five find over 0.99 of the 50-word passages with one edit or two side by side (similarity 0.77 to 0.80).
ENOUGH = 2
#: Shingles on one side of a window's owner that make its groups: together they are 15 and 27 words.
#: The short ones reach into passages with edits, the long ones tell passages apart that begin alike;
#: one side of an owner in 46 shingles (50 words) or more always has room for a long one.
CONTEXTS = ((0, 5, 10), (0, 5, 10, 15, 20, 22))
#: Kinds of keys: 0 and 1 short and long to the left, 2 and 3 to the right.
KINDS = 4
#: Windows of one owner beyond which they are dealt to so many tasks.
CROWD = 10_000
SALTS = 64
#: Windows whose groups a task looks for at once, if one owner doesn't have more.
TOGETHER = 200_000
#: Unmatched shingles inside a passage that don't end it: two edits side by side.
GAP = 10
_POSITION = np.uint64((1 << 28) - 1)


def salts(n: int) -> list[np.uint64]:
    return [np.uint64(x) for x in np.random.default_rng(29).integers(1, 1 << 63, n, dtype=np.uint64)]


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    m, w = v, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def nearest_smaller(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left in the same document, -1 if none: the left links of the Cartesian tree."""
    left = np.arange(len(v)) - 1
    left[np.concatenate([[True], doc[1:] != doc[:-1]])] = -1
    live = np.flatnonzero(left >= 0)
    while len(live):
        to = left[live]
        over = v[to] > v[live]
        live, to = live[over], to[over]
        left[live] = left[to]  # all that lies between is larger still
        live = live[left[live] >= 0]
    return left


def frames(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document of each element, and whether a run of ``width`` elements from it lies in one document: the same under each function."""
    size = np.diff(offsets)
    n = int(offsets[-1])
    return row_ids(size), np.arange(width, n + 1) <= np.repeat(offsets[1:], size)[: max(n - width + 1, 0)]


def compact_windows(values: np.ndarray, offsets: np.ndarray, width: int, frame: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, owner, first and last element of every compact window of at least ``width`` elements.

    ``offsets`` bound the documents in ``values``; of equal values the first
    is the least.
    """
    none = np.zeros(0, np.int64)
    n = len(values)
    if n < width:
        return none, none, none, none
    doc, whole = frame or frames(offsets, width)
    key = (values & ~_POSITION) | np.arange(n, dtype=np.uint64)
    least = (sliding_minimum(key, width)[whole] & _POSITION).astype(np.int64)
    if not len(least):
        return none, none, none, none
    owner = least[np.concatenate([[True], least[1:] != least[:-1]])]  # a sliding minimum moves forward only
    k, d = key[owner], doc[owner]
    left = nearest_smaller(k, d)
    right = len(owner) - 1 - nearest_smaller(k[::-1], d[::-1])[::-1]
    first = np.where(left >= 0, owner[left] + 1, offsets[d])
    last = np.where(right < len(owner), owner[np.minimum(right, len(owner) - 1)] - 1, offsets[d + 1] - 1)
    return d, owner, first, last


def context_key(sh: np.ndarray, owner: np.ndarray, bound: np.ndarray, side: int, steps: tuple[int, ...]) -> np.ndarray:
    """32-bit hash of the words on one side of each owner, never 0; 0 where they don't lie in its window."""
    inside = (owner + side * steps[-1] <= bound) if side > 0 else (owner + side * steps[-1] >= bound)
    acc = np.full(len(owner), 0x51, np.uint64)
    for step in steps:
        at = np.clip(owner + side * step, 0, len(sh) - 1)
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sh[at])
    return np.where(inside, (acc >> np.uint64(32)) | np.uint64(1), np.uint64(0))


def windows(docs: DataFrame, min_words: int = MIN_WORDS, functions: int = FUNCTIONS, *, owners_only: bool = False) -> DataFrame:
    """Compact windows of all texts, in six numbers each: owner's value, doc_id, place, ahead, left, right.

    ``place`` holds the owner's position and how far the window reaches before
    it, ``ahead`` how far behind it and the function, ``left`` and ``right`` the
    short and the long key of that side; see ``unpacked``.  Positions count
    shingles of the text.  The keys are meant beside the owner's value, which is
    different under each function.  ``owners_only`` returns the owners' values
    alone.
    """
    if not 1 <= functions <= 8:
        raise ValueError("1 to 8 functions")
    width = min_words - SHINGLE_WORDS + 1
    names = ["owner", "doc_id", "place", "ahead", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s, e, w = word_spans(part, off)
                sh, so = shingles(word_hashes(part, s, e), w)
                frame = frames(so, width)
                for f, salt in enumerate(salts(functions)):
                    value = mix(sh ^ salt)
                    d, c, first, last = compact_windows(value, so, width, frame)
                    if not len(c):
                        continue
                    owner = pa.array(value[c].astype(np.int64))
                    if owners_only:
                        yield pa.RecordBatch.from_arrays([owner], names[:1])
                        continue
                    sides = [(short << np.uint64(32)) | long for short, long in ([context_key(sh, c, bound, side, steps) for steps in CONTEXTS] for bound, side in ((first, -1), (last, 1)))]
                    columns = [ids[a + d].astype(np.int64), ((c - so[d]) << 32) | (c - first), ((last - c) << 3) | f, *(x.view(np.int64) for x in sides)]
                    yield pa.RecordBatch.from_arrays([owner, *map(pa.array, columns)], names)

    schema = ", ".join(f"{n} bigint" for n in (names[:1] if owners_only else names))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def unpacked(place, ahead) -> dict:
    """c, l, r and f of a window: its owner's position, its first and last, and its function."""
    c = F.shiftright(place, 32)
    return {"c": c.cast("int"), "l": (c - place.bitwiseAND((1 << 32) - 1)).cast("int"), "r": (c + F.shiftright(ahead, 3)).cast("int"), "f": ahead.bitwiseAND(7).cast("int")}


LINK = ["owner", "key", "c", "doc_id", "ref", "f", "l", "r", "rl", "rr"]


def group_links(a: np.ndarray, kinds: tuple[int, ...], once: bool) -> list[np.ndarray]:
    """LINK columns of whole groups: each window with the first document of its groups.

    Rows of ``a`` are owner, salt, doc_id, place, ahead, left, right and whether
    the owner is crowded; columns are sorted by owner and salt.  A crowded
    owner's first windows are linked to themselves.  ``once`` keeps one of
    several keys by which a window has the same first one.
    """
    low = np.int64((1 << 32) - 1)
    part = np.cumsum(np.concatenate([[0], (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1])]))
    at, keys = [], []
    for k in kinds:
        half = a[5 if k < 2 else 6]
        half = (half >> np.int64(32)) & low if k % 2 == 0 else half & low
        some = np.flatnonzero(half)
        at.append(some)
        keys.append(half[some] | np.int64(k << 32))
    i, key = np.concatenate(at), np.concatenate(keys)
    group = (part[i] << 34) | key
    order = np.lexsort((a[3][i], a[2][i], group))
    i, key, group = i[order], key[order], group[order]
    begins = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    j = i[np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))]
    lone = begins & (a[7][i] == 1)
    far = a[2][i] > a[2][j]
    if once:
        pair = np.flatnonzero(far)
        far[:] = False
        far[pair[np.unique(i[pair] * a.shape[1] + j[pair], return_index=True)[1]]] = True
    found = far | lone
    i, j, key = i[found], j[found], key[found]
    c, rc = a[3][i] >> 32, a[3][j] >> 32
    return [a[0][i], key, c, a[2][i], a[2][j], a[4][i] & 7, c - (a[3][i] & low), c + (a[4][i] >> 3), rc - (a[3][j] & low), rc + (a[4][j] >> 3)]


def linked(kept: DataFrame, kinds: tuple[int, ...] = tuple(range(KINDS)), *, once: bool) -> DataFrame:
    """LINK: each window with the first document of each of its groups; ``once`` as in ``group_links``.

    Windows of one owner come together in a task, which finds the groups; it
    holds TOGETHER windows or one owner's at a time.  Those of a crowded owner
    are dealt to SALTS tasks by document: each links its part of a group to the
    part's first document, and these, SALTS at most, are linked to the first of
    all.
    """
    salt = F.when(F.col("crowded"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("bigint")
    kinds_ = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def rows(a: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(group_links(a, kinds, once), kinds_, strict=True)], LINK)

        for batch in batches:
            held.append(np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns]))
            n += batch.num_rows
            if n < TOGETHER:
                continue
            a = np.concatenate(held, 1)
            same = (a[0] == a[0, -1]) & (a[1] == a[1, -1])
            cut = n - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield rows(a[:, :cut])
            held, n = [a[:, cut:]], n - cut
        if n:
            yield rows(np.concatenate(held, 1))

    schema = "owner bigint, key bigint, c int, doc_id bigint, ref bigint, f int, l int, r int, rl int, rr int"
    dealt = kept.select("owner", salt.alias("salt"), "doc_id", "place", "ahead", "left", "right", F.col("crowded").cast("bigint").alias("crowded"))
    found = session.stash(dealt.repartition("owner", "salt").sortWithinPartitions("owner", "salt").mapInArrow(run, schema), "group-links")
    first = F.min(F.struct("doc_id", "c", "l", "r")).over(W.partitionBy("owner", "key"))
    parts = found.where("doc_id = ref").withColumn("first", first).where("doc_id > first.doc_id")
    parts = parts.select("owner", "key", "c", "doc_id", F.col("first.doc_id").alias("ref"), "f", "l", "r", F.col("first.l").alias("rl"), F.col("first.r").alias("rr"))
    return found.where("doc_id > ref").unionByName(parts)


def overlapping(row: np.ndarray, f: np.ndarray, first: np.ndarray, last: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of the intervals that the windows of ``enough`` functions cover, by row."""
    if not len(row):
        return row, first, last
    size = np.int64(last.max()) + 2
    base = (row.astype(np.int64) * 8 + f) * size
    order = np.argsort(base + first, kind="stable")
    start, end = (base + first)[order], (base + last + 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])  # a function's windows joined; those of another begin behind them
    begins, ends = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    place = lambda x: x // (8 * size) * size + x % size
    at = np.concatenate([place(begins), place(ends)])
    step = np.repeat([1, -1], len(begins))
    order = np.lexsort((step, at))
    at, depth = at[order], np.cumsum(step[order])
    settled = np.append(at[1:] != at[:-1], True)
    at, on = at[settled], depth[settled] >= enough
    before = np.concatenate([[False], on[:-1]])
    a, b = at[on & ~before], at[~on & before]
    return a // size, a % size, b % size - 1


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def widened(spans: list[tuple[int, int]], by: int, n: int) -> list[tuple[int, int]]:
    return [(max(a - by, 0), min(b + by, n - 1)) for a, b in spans]


def passages(x: np.ndarray, y: np.ndarray, spans_x: list[tuple[int, int]], spans_y: list[tuple[int, int]], percent: int, width: int) -> list[tuple[int, int, int, int, float]]:
    """Verified passages: first and last shingle in ``x``, those in ``y``, similarity."""
    if not spans_x or not spans_y:
        return []
    at_y = np.concatenate([np.arange(a, b + 1) for a, b in joined_spans(spans_y)])
    value, first = np.unique(y[at_y], return_index=True)
    place = at_y[first]
    latest = at_y[len(at_y) - 1 - np.unique(y[at_y][::-1], return_index=True)[1]]
    least = -(-width * percent // 100)
    found = []
    for a, b in joined_spans(spans_x):
        mine = x[a : b + 1]
        at = np.minimum(np.searchsorted(value, mine), len(value) - 1)
        hit = np.flatnonzero(value[at] == mine)
        # In step with the other text and with edits; in any order, for texts that repeat themselves; in step without edits.
        for gap, in_step in ((GAP, True), (GAP, False), (0, True)):
            if len(hit) < least:
                break
            low, high = place[at[hit]], latest[at[hit]]
            off = np.abs(np.diff(low) - np.diff(hit)) > gap if in_step else False
            cuts = np.flatnonzero((np.diff(hit) > gap + 1) | off) + 1
            rest = []
            for h, w, v in zip(np.split(hit, cuts), np.split(low, cuts), np.split(low if in_step else high, cuts), strict=True):
                p, q = int(w.min()), int(v.max())
                if h[-1] - h[0] + 1 >= width and q - p + 1 >= least:
                    mx, my = np.unique(mine[h[0] : h[-1] + 1]), np.unique(y[p : q + 1])
                    both = len(np.intersect1d(mx, my, assume_unique=True))
                    if 100 * both >= percent * (len(mx) + len(my) - both):
                        found.append((a + int(h[0]), a + int(h[-1]), p, q, both / (len(mx) + len(my) - both)))
                        continue
                rest.append(h)
            hit = np.concatenate(rest) if rest else hit[:0]
    return found


RESULT = "doc_id bigint, start_word int, end_word int, start_char bigint, end_char bigint, ref_doc_id bigint, ref_start_word int, ref_end_word int, n_words int, similarity double"


def parsed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles, first and last bytes of the words, and bytes of each text."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, w = word_spans(part, off)
        sh, so = shingles(word_hashes(part, s, e), w)
        for r in range(b - a):
            span = slice(w[r], w[r + 1])
            yield sh[so[r] : so[r + 1]], s[span] - off[r], e[span] - off[r], part[off[r] : off[r + 1]]


def run_hashes(sh: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` shingles, from prefix sums of a polynomial."""
    step = 0x9E3779B97F4A7C15
    if len(sh) < width:
        return np.zeros(0, np.uint64)
    power, back = (np.cumprod(np.full(len(sh), m, np.uint64)) for m in (step, pow(step, -1, 1 << 64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sh * power)])
    return mix((total[width:] - total[:-width]) * back[: len(sh) - width + 1])


def verified(docs: DataFrame, pairs: DataFrame, percent: int, width: int, enough: int) -> DataFrame:
    """RESULT of the linked documents ``pairs`` (doc_id, ref, links)."""
    texts = session.texts_of(docs, pairs.select(F.explode(F.array("doc_id", "ref")).alias("id")))
    mine = texts.withColumnRenamed("id", "doc_id")
    other = texts.withColumnRenamed("id", "ref").withColumnRenamed("text", "ref_text")
    names = ["doc_id", "start_word", "end_word", "start_char", "end_char", "ref_doc_id", "ref_start_word", "ref_end_word", "n_words", "similarity"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids_, refs = (batch.column(k).to_pylist() for k in (0, 1))
            texts_, links = list(zip(parsed(batch.column(3)), parsed(batch.column(4)), strict=True)), batch.column(2)
            n = np.diff(links.offsets.to_numpy())
            at = row_ids(n)
            f, l, r, rl, rr = (x.to_numpy(zero_copy_only=False) for x in links.flatten().flatten())
            size = np.array([(len(t[0][0]), len(t[1][0])) for t in texts_], np.int64).reshape(-1, 2)
            inside = (r < size[at, 0]) & (rr < size[at, 1])  # else of another text with the same id
            at, f, l, r, rl, rr = (x[inside] for x in (at, f, l, r, rl, rr))
            sides = []
            for low, high in ((l, r), (rl, rr)):
                spans: list[list[tuple[int, int]]] = [[] for _ in texts_]
                for i, p, q in zip(*(v.tolist() for v in overlapping(at, f, low, high, enough)), strict=True):
                    spans[i].append((p, q))
                sides.append(spans)
            for i, ((x, s, e, raw), (y, _, _, _)) in enumerate(texts_):
                mine, other = sides[0][i], sides[1][i]
                if not mine or not other:
                    continue
                # An edit ends a key's words or moves an owner, and the passage goes on behind it.
                got = passages(x, y, widened(mine, width + GAP, len(x)), widened(other, width + GAP, len(y)), percent, width)
                if not all(any(h[0] <= p and q <= h[1] for h in got) for p, q in mine):
                    got += [g for g in passages(x, y, mine, other, percent, width) if not any(h[0] <= g[0] and g[1] <= h[1] for h in got)]
                if not got:
                    continue
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for a, b, p, q, similarity in got:
                    last = min(b + SHINGLE_WORDS, len(s))
                    rows.append((ids_[i], a, last, int(chars[s[a]]), int(chars[e[last - 1]]), refs[i], p, q + SHINGLE_WORDS, last - a, float(similarity)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pairs.join(mine, "doc_id").join(other, "ref").select("doc_id", "ref", "links", "text", "ref_text").mapInArrow(run, RESULT)


def linked_again(docs: DataFrame, kept: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(doc_id, ref, links): documents joined to the first one with the same run of ``width`` shingles, for runs that ``found`` doesn't cover."""
    once = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n")).where("n = 1").select("doc_id")  # else positions are of several texts
    spans = found.join(once, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_word").alias("a"), (F.col("end_word") - SHINGLE_WORDS).alias("b"))).alias("spans"))
    # One side of an owner always has room for a long key in such a run.
    kept = kept.where("(ahead & 7) = 0")
    long = linked(kept, (1, 3), once=False).join(spans, "doc_id", "left")
    low, high = F.greatest("l", F.col("c") - (width - 1)), F.least("r", F.col("c") + (width - 1))
    open_ = long.where(~F.coalesce(F.exists("spans", lambda x: (x["a"] <= low) & (x["b"] >= high)), F.lit(False))).select("owner", "key").distinct()
    half = lambda x: F.col(x).bitwiseAND((1 << 32) - 1)
    keys = F.array(F.when(half("left") != 0, half("left").bitwiseOR(1 << 32)), F.when(half("right") != 0, half("right").bitwiseOR(3 << 32)))
    members = kept.select("owner", "doc_id", "place", "ahead", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"))
    members = members.join(open_.hint("shuffle_hash"), ["owner", "key"], "left_semi")
    u = unpacked(F.col("place"), F.col("ahead"))
    members = members.groupBy("doc_id").agg(F.collect_set(F.struct("owner", *[u[n].alias(n) for n in "clr"])).alias("at"))
    members = session.stash(members.join(spans, "doc_id", "left"), "open-windows")
    texts = session.texts_of(docs, members.select(F.col("doc_id").alias("id")))
    salt = salts(1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows_, covered = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for i, (x, _, _, _) in enumerate(parsed(batch.column(3))):
                own = [w for w in windows_[i] if w["r"] < len(x) and int(mix(x[w["c"] : w["c"] + 1] ^ salt).astype(np.int64)[0]) == w["owner"]]
                if not own:
                    continue
                hashes = run_hashes(x, width)
                starts = [np.arange(max(w["l"], w["c"] - width + 1), min(w["c"], w["r"] - width + 1) + 1) for w in own]
                at = np.concatenate(starts)
                settled = np.zeros(len(at), bool)
                for s in covered[i] or []:
                    settled |= (at >= s["a"]) & (at + width - 1 <= s["b"])
                n = [len(v) for v in starts]
                l, r = (np.repeat(np.array([w[k] for w in own], np.int32), n) for k in ("l", "r"))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(np.full(len(at), ids[i], np.int64)), pa.array(l), pa.array(r), pa.array(settled)], ["run", "doc_id", "l", "r", "settled"])

    rows = members.join(texts.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "at", "spans", "text")
    runs = session.stash(rows.mapInArrow(run, "run bigint, doc_id bigint, l int, r int, settled boolean"), "open-runs")
    lead = runs.groupBy("run").agg(F.min(F.struct("doc_id", "l", "r")).alias("first"), F.max(F.when(~F.col("settled"), F.col("doc_id"))).alias("last")).where("last > first.doc_id")
    again = runs.where("not settled").join(lead.hint("shuffle_hash"), "run").where("doc_id > first.doc_id")
    link = F.struct(F.lit(0).alias("f"), F.col("l"), F.col("r"), F.col("first.l").alias("rl"), F.col("first.r").alias("rr"))
    return again.groupBy("doc_id", F.col("first.doc_id").alias("ref")).agg(F.collect_set(link).alias("links"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 75, functions: int = FUNCTIONS, enough: int = ENOUGH) -> DataFrame:
    """Passages that an earlier document has as well: RESULT, ends exclusive.

    Texts are scanned twice, first for owners alone; only windows whose
    owner occurs twice are kept, and only texts of linked documents are shuffled.
    """
    spark = docs.sparkSession
    session.small_batches(spark)
    twice = windows(docs, min_words, functions, owners_only=True).groupBy("owner").agg(F.count("*").alias("n")).where("n > 1").select("owner", (F.col("n") > CROWD).alias("crowded"))
    kept = session.stash(windows(docs, min_words, functions).join(twice.hint("shuffle_hash"), "owner"), "shared-windows")
    pairs = linked(kept, once=True).groupBy("doc_id", "ref").agg(F.collect_set(F.struct("f", "l", "r", "rl", "rr")).alias("links")).where(F.size(F.array_distinct(F.transform("links", lambda x: x["f"]))) >= enough)
    width = min_words - SHINGLE_WORDS + 1
    found = session.stash(verified(docs, session.stash(pairs, "linked-documents"), percent, width, enough), "first-passages")
    again = session.stash(linked_again(docs, kept, found, width), "documents-linked-again", small=True)
    return found.unionByName(verified(docs, again, percent, width, 1)).distinct()


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages; rows left without a word are dropped, other texts are not touched.

    Only rows of documents with passages are shuffled.  Other columns are
    carried along, whatever their names.
    """
    cuts = found.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("cuts"))
    cuts = session.stash(cuts, "passages-of-documents", small=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    maybe, rest = session.split_by_ids(rows, F.col("id"), cuts)
    joined = maybe.join(cuts, "id", "left")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column(0), []
            columns = row.flatten()
            for text, cut in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, last = [], 0
                for c in cut:
                    left.append(text[last : max(last, c["start_char"])])
                    last = max(last, c["end_char"])
                text = "".join([*left, text[last:]])
                out.append(text if text.strip(" \t\n\v\f\r") else None)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([t is not None for t in out], pa.bool_()))

    touched = joined.where("cuts is not null").select("row", "cuts").mapInArrow(run, T.StructType(docs.schema.fields))
    plain = rest.select("row").unionByName(joined.where("cuts is null").select("row")).select("row.*")
    return plain.unionByName(touched)
