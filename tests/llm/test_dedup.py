"""Similarity operators against brute force."""

import random
import re

import numpy as np
import pytest

from codequarry.llm import components, embedding_dedup, jaccard_join, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(ids, pairs):
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 2), (2, 1)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = dict(map(tuple, components.components(spark.createDataFrame([*pairs, (None, 5)], "a bigint, b bigint")).collect()))
    want = linked({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != 7}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def corpus(seed):
    """Near copies in chains and a large group, common lines, short texts, copies."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, line = [], text(30)
    for _ in range(40):
        base = text(rng.randint(1, 90))
        rows.append(base)
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(base)
    for _ in range(60):
        rows.append(text(rng.randint(5, 40)) + line)
    base = text(80)
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(80)] = "new"
        rows.append(copy)
    return [(i, " ".join(r).upper() if i % 5 == 0 else " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "costly"), [(1, 32), (2, 2), (3, 1)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, seed, costly):
    monkeypatch.setattr(jaccard_join, "COSTLY", costly)
    docs = corpus(seed)
    sets = {i: shingle_set(t) for i, t in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = linked(sets, pairs)
    got = jaccard_join.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_join_odd_rows(odd, none):
    got = jaccard_join.similar_documents(odd).collect()
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[1, 4] == by[2, 4] == 1 and by[3, 0] == 3 and by[4, 0] == 4 and by[5, 0] == 5 and by[7, 1] == 7 and by[7, 2] == 7
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.similar_documents(none).collect() == []


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = [int(v) for v in rng.integers(0, 40, 3)]
        off = np.concatenate([[0], np.cumsum(n)])
        v = rng.integers(0, 12, sum(n)).astype(np.uint64) << np.uint64(40)
        t = int(rng.integers(1, 9))
        want = set()
        for k in range(3):
            for i in range(off[k], off[k + 1]):
                a = b = i
                while a > off[k] and v[a - 1] > v[i]:
                    a -= 1
                while b < off[k + 1] - 1 and v[b + 1] >= v[i]:
                    b += 1
                if b - a + 1 >= t:
                    want.add((k, i, a, b))
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(v, off, t)), strict=True)) == want


def test_repeated_passages_are_found_and_cut(spark, odd, none):
    rng = random.Random(5)
    text = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, edited = text(60), None
    edited = list(passage)
    edited[30] = "changed"
    rows = [(i, " ".join(text(rng.randint(1, 200)) + (passage if i % 3 == 0 else []) + text(20))) for i in range(30)]
    rows += [(100, " ".join(text(10) + edited + text(10))), (101, "Über\n " + " ".join(passage)), (102, " ".join(text(300)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, cuts_ string").drop("cuts_")
    found = substring_dedup.repeated_passages(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {i for i in range(3, 30, 3)} | {100, 101} and all(r["ref_doc_id"] == 0 for r in got.values())
    for i, r in got.items():
        t = dict(rows)[i]
        assert t[r["start_char"] : r["end_char"]].split() == words(t)[r["start_word"] : r["end_word"]] == (edited if i == 100 else passage)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs, found).collect()}
    assert left[102] == dict(rows)[102] and left[0] == dict(rows)[0] and left[101].split() == ["Über"] and passage[3] not in left[3]
    assert substring_dedup.repeated_passages(odd).where("doc_id <> 2").collect() == [] and substring_dedup.repeated_passages(none).collect() == []


def test_a_text_that_is_only_a_repeat_goes(spark):
    t = " ".join(f"k{i}" for i in range(70))
    docs = spark.createDataFrame([(1, t), (2, t), (3, t + " more")], "doc_id bigint, text string")
    left = substring_dedup.without_repeats(docs, substring_dedup.repeated_passages(docs)).collect()
    assert sorted((r["doc_id"], r["text"].strip()) for r in left) == [(1, t), (3, "more")]


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    rows = []
    for b in base:
        for _ in range(int(rng.integers(1, 6))):
            rows.append((b / np.linalg.norm(b) + rng.standard_normal(32) * rng.choice([0.0, 0.01, 0.03])) * rng.uniform(0.5, 2))
    hot = base[0] / np.linalg.norm(base[0])
    rows += [hot + rng.standard_normal(32) * 0.01 for _ in range(120)]
    x = np.array(rows)
    ids = list(range(len(x)))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = linked(ids, [(a, b) for a in ids for b in ids if a < b and near[a, b]])
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [1.0, None] + [0.0] * 30), (1004, [1.0] * 3), (1005, [float("inf")] * 32), (None, [1.0] * 32)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)] + odd, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(ids) + len(odd)
    missed = sum(int(near[i].sum()) - 1 - got[i]["n_links"] for i in ids)
    assert 0 <= missed <= 0.02 * near.sum()
    assert sum(got[i]["component_id"] != want[i] for i in ids) <= 2
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd if i is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []
    twice = embedding_dedup.near_duplicates(df.where("vec_id < 5").unionByName(df.where("vec_id < 5"))).collect()
    assert len(twice) == 10


def test_blocks_of_a_crowded_cell_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.ones(16) + rng.standard_normal((100, 16)) * 0.02
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()} == {(99, 0)}


def test_passages_are_found_behind_earlier_fragments(spark):
    rng = random.Random(8)
    text = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(40):
        passage = text(60)
        parts = [passage[:45], passage[8:53], passage[15:], passage, passage]
        rows += [(100 * i + k, " ".join(text(60) + part + text(60))) for i, part in enumerate(parts)]
        want.add((400 + k, 300 + k))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == want
    t = dict(rows)
    assert all(t[r["doc_id"]][r["start_char"] : r["end_char"]].split() == words(t[r["doc_id"]])[60:120] for r in found)


def test_edited_passages_near_the_threshold_are_found(spark):
    rng = random.Random(3)
    text = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(400):
        passage = text(50)
        edited = list(passage)
        for at in ((20, 21), (10, 11), (25,), (10,))[k % 4]:
            edited[at] = f"edited{k}"
        a, b = shingle_set(" ".join(passage)), shingle_set(" ".join(edited))
        assert 100 * len(a & b) >= 75 * len(a | b)
        rows += [(k, " ".join(text(80) + passage + text(80))), (1000 + k, " ".join(text(80) + edited + text(80)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    pairs = {(r["doc_id"], r["ref_doc_id"]) for r in found}
    assert pairs <= {(1000 + k, k) for k in range(400)} and len(pairs) >= 0.98 * 400


def test_vectors_of_each_length_are_compared(spark):
    rng = np.random.default_rng(9)
    base = {n: rng.standard_normal(n) for n in (16, 24)}
    rows = [(i, (base[16] + rng.standard_normal(16) * 0.01).tolist()) for i in range(6)]
    rows += [(10 + i, (base[24] + rng.standard_normal(24) * 0.01).tolist()) for i in range(4)] + [(20, base[24].tolist()), (21, base[24].tolist()), (30, [1.0] * 5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {i: (5, 0) for i in range(6)} | {i: (5, 10) for i in (10, 11, 12, 13, 20, 21)} | {30: (0, 30)}
