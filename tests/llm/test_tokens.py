"""Byte-level BPE, token counts, media columns and the mix."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from codequarry.llm import bpe, media, mixture, session, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_stitched_boundaries_equal_those_of_the_whole_text():
    c = bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(1)
    for _ in range(150):
        t = "".join(rng.choice(["a", "b'", "'re", "'ll", " ", "  ", "\n", "1", "é", "!!", "   \n ", "'", "x" * 24]) for _ in range(rng.randint(0, 300)))
        whole = [m.end() for m in c.pattern.finditer(t)]
        for chunk, overlap in ((16, 6), (40, 10), (64, 60)):
            assert bpe.stitched_boundaries(c.pattern, t, chunk, overlap) == whole
            assert c.encode(t, chunk, overlap) == np.asarray(c._core.encode_ordinary(t), "<u4").tobytes()


def test_encode_documents_round_trip(spark, odd, none):
    small = bpe.encode_documents(odd, RANKS, P.PATTERN, chunk=64, overlap=16, keep_ids=True).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted((r["decoded_sha256"] for r in small)) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    large = bpe.encode_documents(odd, RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"]) for r in small) == sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"]) for r in large)
    assert all(len(r["ids"]) == r["n_tokens"] for r in small)
    assert bpe.encode_documents(none, RANKS, P.PATTERN).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_documents(odd, RANKS, P.PATTERN, chunk=10, overlap=10)


def test_segments_of_long_texts_equal_the_library(spark):
    c = bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b'", "'re", " ", "  ", "\n", "1", "é", "!!", "   \n ", "word", "漢字", "\U0001f600"]) for _ in range(rng.randint(300, 4000))) for _ in range(25)]
    texts += ["x" * 3000, " " * 2000, "ab " * 900, "short", "", None, texts[0], texts[0]]
    df = spark.createDataFrame([(None if i == 3 else min(i, 26), t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = sorted((len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids)) for t in (x or "" for x in texts) for ids in [c._core.encode_ordinary(t)])
    got = bpe.encode_documents(df, RANKS, P.PATTERN, chunk=64, overlap=24, segment=200, keep_ids=True).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want and sum(r["doc_id"] is None for r in got) == 1


def library_counts(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


ODD_TEXTS = ["", "Don't STOP I'll we'Re 'S", "a\x1cb\x85c\xa0d", "x<|endoftext|>y <|EndOfText|>", "Σίσυφος ΟΔΟΣ", "été É", "İI ıß ŒÆ", "a​b ﻿", "12 34,5.6!!??", "漢字 かな \U0001f600"]


def test_word_counts_equal_the_library():
    path = P.path("word_bpe_49k.json")
    c = token_counts.LibraryCounter(path, True)
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice(ODD_TEXTS + list("abcXYZ '!\n\t09")) for _ in range(60)) for _ in range(100)]
    assert c.count(texts) == library_counts(path, texts)


def test_token_counts_use_and_extend_the_cache(spark, odd, none):
    path, cache = P.path("word_bpe_49k.json"), f"{session.shared_dir(spark)}/tokens-test"
    run = lambda d: token_counts.count_tokens(d, path, cache, fold=True, by_words=True)
    texts = [r["text"] or "" for r in odd.collect()]
    want = sorted(zip([len(t.encode()) for t in texts], library_counts(path, texts), strict=True))
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in run(odd).collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == spark.read.parquet(cache).select("digest").distinct().count()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in run(odd).collect()) == want
    assert spark.read.parquet(cache).count() == stored  # all hits
    assert run(none).collect() == []


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_confirms_and_carves():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x")
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    files = {"audio/wav": media.wav_bytes(b"abc"), "image/png": png(), "image/gif": gif, "image/bmp": bmp, "application/gzip": gzip.compress(b"hello"), "application/zip": z.getvalue(), "application/pdf": b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"}
    for kind, data in files.items():
        assert [(f.kind, f.start, f.length) for f in media.sniff(data)] == [(kind, 0, len(data))], kind
        inside = media.sniff(b"BM RIFF junk" + data + b"tail")
        assert [(f.kind, f.start, f.length) for f in inside] == [(kind, 12, len(data))], kind
        assert media.sniff(data[:-1]) == [] or kind in ("application/zip", "application/pdf")
    assert media.sniff(b"") == media.sniff(None) == media.sniff(b"BM RIFF PK\x03\x04 %PDF- GIF89a") == []


def test_sniff_column_corrects_types(spark):
    d = spark.createDataFrame([(1, bytearray(png()), "image/jpeg", "k"), (2, bytearray(b"text"), "text/plain", "k"), (3, None, None, "k"), (4, bytearray(b"--" + png()), "text/plain", "k")], "id int, media binary, declared_type string, carved string")
    got = {r["id"]: r for r in media.sniff_column(d).collect()}
    assert [got[i]["actual_type"] for i in (1, 2, 3, 4)] == ["image/png", "text/plain", None, "text/plain"]
    assert [(c["type"], c["start"]) for c in got[4]["carved"]] == [("image/png", 2)] and not got[1]["carved"]


def test_text_media_reads_back_its_payload(odd, none):
    for r, t in zip(media.text_media(odd).collect(), [r["text"] for r in odd.collect()], strict=True):
        n, payload = media.payload_of(t)
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0 < len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.text_media(none).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague_takes_the_highest_quotients(seed):
    rng = random.Random(seed)
    w = [rng.choice([0.0, 1.0, 2.5, rng.random() * 9]) for _ in range(rng.randint(1, 7))]
    cap = [rng.randint(0, 12) for _ in w]
    seats = rng.randint(0, 40)
    quotients = sorted(((-x / (2 * s + 1), i) for i, (x, c) in enumerate(zip(w, cap, strict=True)) if x > 0 for s in range(c)))
    want = [0] * len(w)
    for _, i in quotients[:seats]:
        want[i] += 1
    assert mixture.sainte_lague(w, seats, cap) == want


def test_water_fill():
    assert mixture.water_fill([3, 1, 2], [100, 100, 100], 60) == [30, 10, 20]
    assert mixture.water_fill([3, 1, 2], [10, 100, 100], 60) == [10, pytest.approx(50 / 3), pytest.approx(100 / 3)]
    assert mixture.water_fill([1, 1], [5, 5], 60) == [5, 5] and mixture.water_fill([], [], 9) == []


def test_mix_meets_its_targets_and_repeats(spark, odd, none):
    import pyspark.sql.functions as F

    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 7, F.lit(3))).alias("source"))
    m = mixture.mix(many, block=32, shard_tokens=2000)
    rows = m.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture.mix(many, block=32, shard_tokens=2000).collect()))
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"] + 64
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and len(rows) == 3000
    assert len(mixture.mix(odd).collect()) == odd.count() and mixture.mix(none).collect() == []
    out = mixture.mixed_documents(odd)
    assert out.columns == odd.columns and mixture.mixed_documents(none).collect() == []
