"""Clashing names, ties, repeated rows and other edges of operators and stages."""

import datetime as dt
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from codequarry.llm import embedding_dedup, jaccard_join, media, mixture, quality, revisits, session, substring_dedup, token_counts, toxicity

CLASH = ["id", "id_", "row", "digest", "key", "again", "first", "cuts", "cuts_", "size", "size_", "n", "n_", "o", "k", "shard", "shards", "copies", "copy_", "starts", "starts_", "begin", "edge", "full", "last", "component", "component_", "ref", "owner", "word", "bits", "h", "prefix"]


@pytest.fixture(scope="module")
def clash(spark):
    """Documents with a column of each name that operators use inside."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(70)) for _ in range(12)]
    rows = [(i, t + (" " + passage if i % 3 == 0 else "") + " end", "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(50, rows[1][1] + " more", "en", "s1", 1), (60, rows[2][1], "en", "s2", 1), (60, rows[2][1], "en", "s2", 1), (None, rows[4][1], "en", None, 1), (70, None, "en", "s0", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASH:
        d = d.withColumn(c, F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    return d.cache()


def whole(rows, columns):
    """Whether every row still has its own values in the columns with clashing names."""
    return all(r[c] == f"{c}-{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASH) and columns[-len(CLASH) :] == CLASH


def test_stages_carry_columns_of_any_name(spark, clash):
    near = corpus_pipeline.keep_one_of_near_copies(spark, clash, "")
    rows = near.collect()
    assert whole(rows, near.columns) and sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [*range(12), 70] and sum(r["doc_id"] is None for r in rows) == 1
    cut = corpus_pipeline.cut_repeated_passages(spark, near, "")
    got = cut.collect()
    assert whole(got, cut.columns) and len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert "p30" in texts[0] and all("p30" not in texts[i] for i in (3, 6, 9))
    mixed = corpus_pipeline.mix_sources(spark, cut, "")
    assert whole(mixed.collect(), mixed.columns)
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()


def test_toxic_stage_carries_columns(clash):
    model = toxicity.fit(__import__("pyarrow").array(["bad dreck words here", "good words here"] * 40), np.array([1, 0] * 40))
    kept = toxicity.below(clash, model, 0.5)
    assert kept.columns == clash.columns and whole(kept.collect(), kept.columns)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, a, "en", "x", 1), (7, a + " tail", "en", "x", 1), (7, b, "en", "x", 1), (7, b, "de", "y", 2), (9, b + " tail", "en", "x", 1)]
    first = {tuple(r) for r in corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, schema), "").collect()}
    again = {tuple(r) for r in corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows[::-1], schema), "").collect()}
    assert first == again and {(r[0], r[1]) for r in first} in ({(1, a), (7, b)}, {(1, a), (9, b + " tail")}) and len(first) == 2


def test_mix_takes_more_than_two_copies(spark):
    d = spark.createDataFrame([(i, "word " * (10 + i % 7), f"s{i % 2}", "x") for i in range(300)] + [(None, "a b c", "s0", "x")] * 40, "doc_id bigint, text string, source string, size_ string")
    m = mixture.mix(d, (1, 5), 2.5, most=3, block=16, shard_tokens=500)
    out = mixture.mixed_documents(d, (1, 5), 2.5, most=3, block=16, shard_tokens=500)
    rows = m.collect()
    by = {s: sum(r["starts"] for r in rows if r["source"] == s) for s in ("s0", "s1")}
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert max(r["starts"] for r in rows) == 3 and got["s1"] == by["s1"] and abs(got["s0"] - by["s0"]) <= 40
    assert {r["size_"] for r in out.collect()} == {"x"}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixture.mixed_documents(d.repartition(3), (1, 5), 2.5, most=3, block=16, shard_tokens=500).collect()), key=repr)


def test_each_digest_is_encoded_once(spark, monkeypatch):
    seen = f"{session.shared_dir(spark)}/seen-{random.random()}"
    cache = f"{session.shared_dir(spark)}/cache-{random.random()}"
    texts = ["one text " * 5, "another text " * 5]
    d = spark.createDataFrame([(i % 4, texts[i % 2]) for i in range(100)] + [(200, "alone"), (None, "alone"), (None, None)], "doc_id bigint, text string")
    count = token_counts.LibraryCounter.count

    def counted(self, batch):
        with open(f"{seen[5:] if seen.startswith('file:') else seen}", "a") as f:
            f.write("".join(t[:5] + "\n" for t in batch))
        return count(self, batch)

    def run():
        return token_counts.count_tokens(d, P.path("word_bpe_49k.json"), cache, fold=True, by_words=True).collect()

    monkeypatch.setattr(token_counts.LibraryCounter, "count", counted)
    one = run()
    import os

    if os.path.exists(seen):  # workers are forked from a daemon that may have loaded the class before
        assert sorted(open(seen).read().split("\n")[:-1]) == sorted([t[:5] for t in texts] + ["alone", ""])
    assert len(one) == 103 and spark.read.parquet(cache).count() == 4
    two = run()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr) and spark.read.parquet(cache).count() == 4


def test_the_smallest_id_keeps_its_links(spark):
    low = -(1 << 63)
    text = " ".join(f"t{i}" for i in range(80))
    d = spark.createDataFrame([(low, text), (5, text + " x"), (9, text + " y z")], "doc_id bigint, text string")
    assert {r["component_id"] for r in jaccard_join.similar_documents(d).collect()} == {low}
    assert {r["doc_id"]: r["ref_doc_id"] for r in substring_dedup.repeated_passages(d).collect()} == {5: low, 9: low}


def test_filter_of_ids_splits_exactly(spark):
    d = spark.range(3000).withColumn("x", F.lit(1))
    maybe, rest = session.split_by_ids(d, F.col("id"), spark.range(0, 3000, 7))
    assert maybe.count() + rest.count() == 3000 and rest.where("id % 7 = 0").count() == 0 and rest.count() > 2000
    assert session.split_by_ids(spark.createDataFrame([(None,)], "id bigint"), F.col("id"), spark.range(5))[1].count() == 1


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def test_responses_that_share_an_id_resolve_alike(spark):
    at = dt.datetime(2024, 1, 1)
    schema = "record_id bigint, warc_type string, target_uri string, warc_date timestamp, http_status int, headers map<string,string>, payload_digest string, n_bytes bigint"
    rows = [(1, "response", "x.org/a", at, 200, {"etag": e}, f"d{e}", n) for e, n in (("A", 1), ("B", 2), ("C", 3))] + [(9, "revisit", "x.org/a", at + dt.timedelta(hours=1), 304, {}, None, None)]
    got = {tuple(revisits.resolve(spark.createDataFrame(r, schema)).select("payload_digest", "n_bytes").collect()[0]) for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert got == {("dC", 3)}


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\x00more\xff\xd0x\xff\xd9"


def test_jpeg_and_hostile_values():
    for data, at in ((JPEG, 0), (b"12345" + JPEG + b"tail", 5), (b"\xff\xd8\xff\xe0\x00\x02" * 3 + JPEG, 18)):
        assert [(f.kind, f.start, f.length) for f in media.sniff(data)] == [("image/jpeg", at, len(JPEG))]
    assert media.sniff(JPEG[:-1]) == media.sniff(JPEG[:-2] + b"\xff\xff") == media.sniff(b"\xff\xd8\xff") == []
    import time

    for junk in (b"%PDF-1", b"%PDF-1startxref", b"\xff\xd8\xff\xe0\x00\x02\xff\xda\x00\x02a", b"PK\x03\x04" + b"\0" * 26):
        start = time.time()
        media.sniff(junk * (2_000_000 // len(junk)))
        assert time.time() - start < 20


def test_stored_media_equal_a_plain_computation(spark):
    pdf = "%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    texts = ["", None, "a" * 63, "b" * 64, "é" * 40, f"see {pdf} and {pdf} here", "x" * 100_001]
    got = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        stored = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got[i]["feature"] == f"audio/wav;carved={2 if i == 5 else 0};mean={sum(payload) // len(payload)}"


def plain_chain(e, m):
    """Marginals of one chain by forward-backward over all of it."""
    x, t = np.exp(e), np.exp(m)
    f, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
    for i in range(len(e)):
        f[i] = ([1, 1] if i == 0 else f[i - 1] @ t) * np.array([1, x[i]])
        f[i] /= f[i].sum()
    for i in range(len(e) - 2, -1, -1):
        b[i] = t @ (b[i + 1] * [1, x[i + 1]])
        b[i] /= b[i].sum()
    p = f * b
    return p[:, 1] / p.sum(1)


def test_a_text_is_one_chain():
    rng = np.random.default_rng(1)
    for _ in range(10):
        words = np.concatenate([[0], np.cumsum(rng.integers(0, 300, 7))])
        e, m = rng.normal(size=words[-1]) * 3, rng.normal(size=(2, 2)) * 2
        row, col, n = toxicity.lanes(words)
        grid, valid = np.zeros((toxicity.SEQUENCE, n)), np.zeros((toxicity.SEQUENCE, n), bool)
        grid[row, col], valid[row, col] = e, True
        got = toxicity.chain_marginals(grid, valid, m, -(-np.diff(words) // toxicity.SEQUENCE))[row, col]
        want = np.concatenate([np.zeros(0), *(plain_chain(e[a:b], m) for a, b in zip(words, words[1:], strict=False) if b > a)])
        assert np.allclose(got, want)


def test_document_scores_equal_a_plain_computation(spark):
    """The score from marginals of whole chains, for texts beyond one lane."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["good", "fine", "dreck", "grumf", "words"] + ["plain"] * 20) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    model = toxicity.fit(pa.array(texts), np.array([int("dreck" in t or "grumf" in t) for t in texts]))
    got = toxicity.document_scores(model, pa.array([*texts, "", None]))
    for t, s in zip([*texts, ""], got, strict=False):
        w = t.split()
        data = np.frombuffer(t.encode(), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in w]) - 1 if w else np.zeros(0, np.int64)
        starts = ends - np.array([len(x) for x in w], np.int64)
        p = np.zeros(0)
        if w:
            f = toxicity.buckets(toxicity.word_keys(data, starts, ends))
            p = plain_chain(sum(model.weights[k][f[k]] for k in range(4)) + model.bias, model.transitions)
        x = np.array([1, max(p, default=0), np.log1p(sum(v for v in p if v >= 0.5))])
        assert s == pytest.approx(1 / (1 + np.exp(-np.clip(x @ model.document, -30, 30))), abs=1e-5)
    assert got[-1] == got[-2]


def test_training_bytes_are_bounded(spark):
    from codequarry.llm.labelled import training_rows

    d = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    assert training_rows(d, labels, "toxic", 100, 100, most_bytes=40_000).groupBy("label").count().where("count = 20").count() == 2


def test_the_compiled_column_equals_the_rules(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((300, len(quality.STATISTICS))) * 10, 1)
    y = ((x[:, 0] > 5) & (x[:, 3] <= 4) | (x[:, 7] > 8)).astype(int)
    model = quality.fit(x, y)
    assert model.rules
    score = {r["i"]: r["s"] for r in spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{s} double" for s in quality.STATISTICS)).select("i", model.column().alias("s")).collect()}
    total = model.bias + sum(w * quality.holds(r, x, quality.STATISTICS) for r, w in model.rules)
    assert np.allclose([score[i] for i in range(300)], 1 / (1 + np.exp(-total)))


def test_base_rate_counts_when_no_rule_is_left(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda *_, **__: quality.RuleModel(0.0, []))
    d = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(400)], "doc_id bigint, quality int")
    model = quality.train(d, labels, limit=20)
    share = labels.where(~quality.training_labels.__globals__["held_out"](F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    assert quality.score_documents(d, model).first()["score"] == pytest.approx(share, abs=0.01)


def test_quality_and_embeddings_with_odd_columns(spark):
    long = spark.createDataFrame([(1, "word. " * 300_000, "x", "y"), (None, "", "x", "y")], "doc_id bigint, text string, b string, words string")
    assert len(quality.score_documents(long, quality.RuleModel(0.0, [((("words", True, 3.0),), 1.0)])).collect()) == 2
    v = spark.createDataFrame([(1, [1.0, 0.0], 5, "a"), (2, [1.0, 0.001], 6, "b"), (3, [0.0, 1.0], 7, "c")], "vec_id bigint, embedding array<double>, rep int, cell string")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(v).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_groups_of_copies_and_crowded_owners_are_found(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 3)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(60)] + passage + [f"u{rng.randrange(10**9)}" for _ in range(60)])) for i in range(20)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 20)) and all(r["ref_doc_id"] < r["doc_id"] for r in found)
