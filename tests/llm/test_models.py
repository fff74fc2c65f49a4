"""Classifiers by held-out accuracy, revisits by hand, the pipeline end to end."""

import datetime as dt
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from codequarry.llm import labelled, quality, revisits, toxicity

BAD = ["dreckfoo", "dreckbar", "grumf", "zonk"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(600)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic, junk = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        text = " ".join(x.upper() + "!!" for x in w) if junk and not toxic else ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not (junk and not toxic)), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache()


def held(spark, scored, labels, label):
    j = scored.where(labelled.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", label).collect()
    return np.array([r[0] for r in j]), np.array([r[1] for r in j])


def test_toxic_spans_on_held_out_rows(spark, corpus, odd, none):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    s, y = held(spark, toxicity.score_documents(docs, model), labels, "toxic")
    assert len(y) > 100 and ((s >= 0.5) == y).mean() > 0.97
    d = spark.createDataFrame([(1, "  nice é dreckzap, GRUMF! fine"), (2, None)], "doc_id bigint, text string")
    one, two = toxicity.score_documents(d, model, spans=True).orderBy("doc_id").collect()
    text = "  nice é dreckzap, GRUMF! fine"
    assert [text[x["start"] : x["end"]] for x in one["spans"]] == ["dreckzap, GRUMF!"] and two["spans"] == [] and two["score"] < 0.5
    assert len(toxicity.score_documents(odd, model).collect()) == odd.count() and toxicity.score_documents(none, model).collect() == []
    assert toxicity.below(odd, model, 0.5).columns == odd.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    e, m = rng.standard_normal((5, 1)), rng.standard_normal((2, 2))
    p = toxicity.marginals(e, np.ones((5, 1), bool), m)
    weight = {}
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        weight[tuple(y)] = np.exp(sum(e[i, 0] for i in range(5) if y[i]) + sum(m[y[i], y[i + 1]] for i in range(4)))
    z = sum(weight.values())
    assert np.allclose(p[:, 0], [sum(v for y, v in weight.items() if y[i]) / z for i in range(5)])


def test_quality_rules_on_held_out_rows(spark, corpus, odd, none):
    docs, labels = corpus
    model = quality.train(docs, labels)
    s, y = held(spark, quality.score_documents(docs, model), labels, "quality")
    assert ((s >= 0.3) == y).mean() > 0.97 and model.rules
    got = quality.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and quality.score_documents(none, model).collect() == []


def test_models_without_labels(spark, corpus, odd):
    docs, labels = corpus
    for part, want in ((labels.limit(0), (0.0, 0.5)), (labels.where("toxic = 1 and quality = 1"), (1.0, 0.999))):
        t = toxicity.score_documents(odd, toxicity.train(docs, part)).first()["score"]
        q = quality.score_documents(odd, quality.train(docs, part)).first()["score"]
        assert t == pytest.approx(want[0], abs=1e-3) and q == pytest.approx(want[1], abs=2e-3)


def test_lasso_leaves_useless_rules_out():
    rng = np.random.default_rng(1)
    z = (rng.random((600, 5)) > 0.5).astype(float)
    y = (z[:, 0] > 0.5).astype(float)
    _, w = quality.lasso(z, y, 0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.1


T0 = dt.datetime(2024, 1, 1)


def test_revisits_by_case(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    full = lambda i, u, h, e, **k: (i, "response", u, at(h), 200, {"etag": e, "content-type": "text/html", "cache-control": "old", **k}, f"d{i}", 10 * i)
    ask = lambda i, u, h, **k: (i, "revisit", u, None if h is None else at(h), 304, k, None, None)
    rows = [
        full(1, "http://www.X.org/a/?utm_source=q#f", 0, "A"), full(2, "https://x.org/a", 5, "B"), full(3, "https://x.org/a", 5, "B"), full(4, "https://x.org/a", 90, "C"),
        ask(10, "https://x.org:443/a/", 80, etag="B", **{"cache-control": "new", "content-type": "no"}), ask(11, "x.org/a", 4), ask(12, "x.org/a", 0), ask(13, "x.org/a", 95, etag="Z"),
        ask(14, None, 3), ask(15, "x.org/a", None), ask(16, "x.org/none", 3), ask(10, "https://x.org:443/a/", 80, etag="B", **{"cache-control": "new", "content-type": "no"}),
        (20, "response", "x.org/none", at(1), 404, None, "d", 1), (21, "warcinfo", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, warc_type string, target_uri string, warc_date timestamp, http_status int, headers map<string,string>, payload_digest string, n_bytes bigint, status string")
    got = revisits.resolve(df).collect()
    by = {r["record_id"]: r for r in got}
    assert len(got) == 8 and {i: (r["status"], r["response_id"]) for i, r in by.items()} == {10: ("resolved", 3), 11: ("resolved", 1), 12: ("no_response", None), 13: ("validator_mismatch", 4), 14: ("no_key", None), 15: ("no_key", None), 16: ("no_response", None)}
    assert by[10]["headers"] == {"etag": "B", "cache-control": "new", "content-type": "text/html"} and (by[10]["http_status"], by[10]["payload_digest"], by[10]["n_bytes"]) == (200, "d3", 30)
    assert (by[13]["http_status"], by[13]["payload_digest"], by[13]["n_bytes"]) == (304, None, None)
    assert revisits.resolve(df.limit(0)).collect() == []


def test_pipeline_on_a_small_corpus(spark, corpus, tmp_path):
    docs, labels = corpus
    passage = " ".join(f"p{i}" for i in range(70))
    extra = [(2000, "near " + passage, "en", "s", 1), (2001, "near " + passage + " copy", "en", "s", 1), (2002, "own words " + " ".join(f"q{i}" for i in range(60)) + " " + passage + " and more", "en", "s", 1), (2003, None, None, None, None), (None, "no id", "en", "s", 5)]
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path)).cache()
        seen[name] = d.collect()
        if name != "byte_bpe":
            assert d.columns == docs.columns
    left = {r["doc_id"] for r in seen["toxicity"]}
    bad = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(left & bad) <= 3 and len({r["doc_id"] for r in labels.where("toxic = 0").collect()} - left) <= 3 and {2003, None} <= left
    near = {r["doc_id"] for r in seen["ngram_jaccard_join"]}
    assert 2000 in near and 2001 not in near and {2002, 2003, None} <= near
    texts = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    assert texts[2000] == "near " + passage and "p33" not in texts[2002] and texts[2002].startswith("own words")
    assert {r["doc_id"] for r in seen["source_mix"]} <= set(texts) and len(seen["byte_bpe"]) == len(seen["source_mix"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen["byte_bpe"])
