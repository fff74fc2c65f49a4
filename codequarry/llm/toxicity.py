"""Toxic spans by a linear-chain conditional random field.

Two tags (clean, toxic) over the words of a text, which is one chain from its
first word to its last.  A word's features are hashes of the word, of its first four
and five bytes and of its last four.  Forward-backward gives every word its
marginal; the marginals give the document's score, and runs of marginals of at
least one half the offending offsets.

Only documents carry labels, so token labels are derived first: in toxic
training documents the words and stems that a likelihood-ratio test ties to the
toxic label are tagged toxic.  Everything is learned from a bounded sample of
training rows, the field from pieces of ``SEQUENCE`` words of them; scoring
reads whole texts.

Null and empty texts get the score of a document without toxic words and no
spans.  Repeated rows get equal results, a null ``doc_id`` stays null.  With no
labelled row, or one class only, the score is the share of toxic labels (0
without any).  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import session
from .labelled import training_labels, training_rows
from .textcore import _LOWER, SLICE_BYTES, mix, row_ids, shingles, slices, text_buffer, word_hashes, word_spans

#: Words of a training piece, and of a lane in which a chain's words are worked on.
SEQUENCE = 64
BUCKETS = 1 << 16
#: Clean and toxic labelled documents to fit on, at most.
TRAINING_ROWS = (3000, 1000)
#: Bytes of text to fit on, at most: rows beyond are left out of the sample, in the order of the ids' hashes.
TRAINING_BYTES = 8 << 20
#: Likelihood ratio from which a word or stem counts as tied to the label.
TIED = 20.0
_SALTS = [np.uint64(s) for s in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0x94D049BB133111EB)]


@dataclass
class Crf:
    weights: np.ndarray  # one row a feature kind
    bias: float
    transitions: np.ndarray  # from tag, to tag
    document: np.ndarray  # bias, largest marginal's weight, weight of the tagged words' marginals
    constant: float | None = None


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """64-bit keys of the feature kinds: word, first four bytes, first five, last four.  Marks around a word are dropped."""
    lower = _LOWER[data]
    letter = (lower >= 128) | ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57))
    count = np.concatenate([[0], np.cumsum(letter)])
    at = np.flatnonzero(letter)
    some = count[ends] > count[starts]
    a = np.where(some, at[np.minimum(count[starts], len(at) - 1)] if len(at) else starts, starts)
    b = np.where(some, at[np.maximum(count[ends] - 1, 0)] + 1 if len(at) else ends, ends)
    size = b - a
    return [
        word_hashes(data, a, b) ^ _SALTS[0],
        word_hashes(data, a, a + np.minimum(size, 4)) ^ _SALTS[1],
        word_hashes(data, a, a + np.minimum(size, 5)) ^ _SALTS[2],
        word_hashes(data, b - np.minimum(size, 4), b) ^ _SALTS[3],
    ]


def buckets(keys: list[np.ndarray]) -> np.ndarray:
    return np.stack([(mix(k) >> np.uint64(48)).astype(np.int32) for k in keys])


def lanes(word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each word in the (SEQUENCE, n) matrix of sequences, and n."""
    words = np.diff(word_offsets)
    per = -(-words // SEQUENCE)
    first = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(word_offsets[-1]) - np.repeat(word_offsets[:-1], words)
    return within % SEQUENCE, np.repeat(first[:-1], words) + within // SEQUENCE, int(first[-1])


def marginals(emission: np.ndarray, valid: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """P(toxic) of each word of the sequences; with ``pairs`` also the expected transition counts.

    ``emission`` (steps, lanes) is the toxic tag's score over the clean one's.
    """
    steps, n = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(transitions)
    f = np.zeros((steps, 2, n))
    f[0, 0], f[0, 1] = 1, e[0]
    f[0] /= f[0].sum(0)
    for t in range(1, steps):
        p = f[t - 1]
        f[t, 0] = p[0] * m[0, 0] + p[1] * m[1, 0]
        f[t, 1] = (p[0] * m[0, 1] + p[1] * m[1, 1]) * e[t]
        f[t] /= f[t].sum(0)
    out = np.zeros((steps, n))
    expected = np.zeros((2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            live = valid[t + 1]
            c0, c1 = b0, b1 * e[t + 1]
            if pairs:
                joint = np.stack([[f[t, i] * m[i, j] * (c0, c1)[j] for j in (0, 1)] for i in (0, 1)])
                joint = joint / np.maximum(joint.sum((0, 1)), 1e-300) * live
                expected += joint.sum(2)
            n0, n1 = m[0, 0] * c0 + m[0, 1] * c1, m[1, 0] * c0 + m[1, 1] * c1
            s = n0 + n1
            b0, b1 = np.where(live, n0 / s, 1.0), np.where(live, n1 / s, 1.0)
        num = f[t, 1] * b1
        out[t] = num / (num + f[t, 0] * b0)
    return (out, expected) if pairs else out


def copy_groups(least: np.ndarray) -> np.ndarray:
    """For each text the first one with one of its least shingles: copies of one text must not count as separate evidence."""
    out = np.arange(len(least))
    for column in least.T:
        _, first, where = np.unique(column, return_index=True, return_inverse=True)
        out = np.minimum(out, out[first[where]])
    return out


def tied_keys(keys: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Keys that occur in documents of the toxic class far more often than chance allows.

    ``keys`` and ``doc`` are distinct pairs, sorted by key.
    """
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    hit = np.add.reduceat(toxic[doc], first)
    seen = np.diff(np.append(first, len(keys)))
    rate = toxic[np.unique(doc)].mean()
    q = np.clip(hit / seen, 1e-9, 1 - 1e-9)
    ratio = 2 * (hit * np.log(q / rate) + (seen - hit) * np.log((1 - q) / (1 - rate)))
    return keys[first[(ratio >= TIED) & (q >= 0.8)]]


def distinct_pairs(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[new], doc[new]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
    return w


def document_inputs(p: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Constant, largest marginal and log of one plus the summed marginals of the tagged words of each row.

    Words below one half are left out of the sum: in a long text they would add up.
    """
    words = np.diff(word_offsets)
    top, total = np.zeros(len(words)), np.zeros(len(words))
    some = words > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, word_offsets[:-1][some])
        total[some] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), word_offsets[:-1][some])
    return np.stack([np.ones(len(words)), top, np.log1p(total)], 1)


def parts(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, bytes, word starts and ends, and word offsets of each slice of the texts."""
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets, limit):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, part, *word_spans(part, off)


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 60) -> Crf:
    """The field's weights and the document score's, from labelled texts, slice by slice."""
    empty = np.zeros((len(_SALTS), BUCKETS), np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Crf(empty, 0.0, np.zeros((2, 2)), np.zeros(3), float(labels.mean()) if len(labels) else 0.0)
    toxic = labels.astype(float)
    least = np.stack([np.arange(len(labels), dtype=np.uint64)] * 3, 1)
    for a, b, data, starts, ends, words in parts(texts, SLICE_BYTES // 2):
        sh, so = shingles(word_hashes(data, starts, ends), words)
        some = np.flatnonzero(np.diff(so))
        for k, salt in enumerate(_SALTS[:3]):
            if len(some):
                least[a + some, k] = np.minimum.reduceat(mix(sh ^ salt), so[some])
    copy = copy_groups(least)
    tied = []
    for k in (0, 1, 2):
        found = []
        for a, _, data, starts, ends, words in parts(texts, SLICE_BYTES // 2):
            found.append(distinct_pairs(word_keys(data, starts, ends)[k], copy[a + row_ids(np.diff(words))]))
        keys, doc = distinct_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
        tied.append(tied_keys(keys, doc, toxic) if len(keys) else keys)
    # Sequences with a tagged word, and three times as many others for contrast, spread evenly.
    sets: list[tuple[np.ndarray, ...]] = []
    lanes_n = 0
    for a, _, data, starts, ends, words in parts(texts, SLICE_BYTES // 2):
        keys = word_keys(data, starts, ends)
        tag = labels[a + row_ids(np.diff(words))] == 1
        tag &= np.any([np.isin(keys[k], tied[k]) for k in (0, 1, 2)], axis=0)
        row, col, n = lanes(words)
        held = np.zeros(n, bool)
        held[col[tag]] = True
        held |= np.arange(n) % max(1, n // max(1, 3 * int(held.sum()))) == 0
        keep = held[col]
        renumber = np.cumsum(held) - 1 + lanes_n
        lanes_n += int(held.sum())
        sets.append((row[keep], renumber[col[keep]], buckets([x[keep] for x in keys]), tag[keep]))
    row_k, col_k, y_k = (np.concatenate([s[i] for s in sets]) for i in (0, 1, 3))
    f_k = np.concatenate([s[2] for s in sets], 1)
    valid = np.zeros((SEQUENCE, lanes_n), bool)
    valid[row_k, col_k] = True
    y = np.zeros((SEQUENCE, lanes_n), np.int8)
    y[row_k, col_k] = y_k
    seen = np.array([[((y[:-1] == i) & (y[1:] == j) & valid[1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, bias, moves = np.zeros((len(_SALTS), BUCKETS)), -2.0, np.zeros((2, 2))
    g2w, g2b, g2t = np.full(weights.shape, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(rounds):  # AdaGrad on the conditional likelihood
        e = np.zeros((SEQUENCE, lanes_n))
        e[row_k, col_k] = sum(weights[k][f_k[k]] for k in range(len(_SALTS))) + bias
        p, expected = marginals(e, valid, moves, pairs=True)
        gap = y_k - p[row_k, col_k]
        for k in range(len(_SALTS)):
            g = np.bincount(f_k[k], weights=gap, minlength=BUCKETS) - 0.02 * weights[k]
            g2w[k] += g * g
            weights[k] += 0.5 * g / np.sqrt(g2w[k])
        g2b += gap.sum() ** 2
        bias += 0.3 * gap.sum() / np.sqrt(g2b)
        g = seen - expected - 0.02 * moves
        g2t += g * g
        moves += 0.2 * g / np.sqrt(g2t)
    model = Crf(weights.astype(np.float32), float(bias), moves, np.zeros(3))
    inputs = [document_inputs(text_marginals(model, data, starts, ends, words), words) for _, _, data, starts, ends, words in parts(texts, SLICE_BYTES // 2)]
    model.document = logistic(np.concatenate(inputs), toxic)
    return model


def text_marginals(model: Crf, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """P(toxic) of every word."""
    return word_marginals(model, buckets(word_keys(data, starts, ends)), words) if len(starts) else np.zeros(0)


def word_marginals(model: Crf, feature: np.ndarray, words: np.ndarray) -> np.ndarray:
    row, col, n = lanes(words)
    e = np.zeros((SEQUENCE, n))
    valid = np.zeros((SEQUENCE, n), bool)
    valid[row, col] = True
    e[row, col] = sum(model.weights[k][feature[k]] for k in range(len(_SALTS))) + model.bias
    return chain_marginals(e, valid, model.transitions, -(-np.diff(words) // SEQUENCE))[row, col]


def chain_marginals(emission: np.ndarray, valid: np.ndarray, transitions: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """P(toxic) of each word, each text being one chain: ``blocks`` says how many lanes in a row are one text's.

    Lanes only order the work.  Each lane is reduced to the matrix that takes a
    message from its start to its end; the messages at the borders follow from
    those, lane after lane of all texts at once, and then each lane's words.
    """
    steps, n = emission.shape
    if not n:
        return emission
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(transitions)
    g = np.zeros((2, 2, n))  # from the tag before the first word's emission, to the tag after the last's
    g[0, 0], g[1, 1] = 1, e[0]
    for t in range(1, steps):
        to = np.stack([g[:, 0] * m[0, 0] + g[:, 1] * m[1, 0], (g[:, 0] * m[0, 1] + g[:, 1] * m[1, 1]) * e[t]], 1)
        g = np.where(valid[t], to / to.sum((0, 1)), g)
    order = np.argsort(-blocks, kind="stable")
    start, count = (np.concatenate([[0], np.cumsum(blocks)])[:-1])[order], blocks[order]
    before, behind = np.ones((2, n)), np.ones((2, n))
    for j in range(1, int(count[0])):
        at = start[: np.searchsorted(-count, -j)] + j
        out = before[0, at - 1] * g[0][:, at - 1] + before[1, at - 1] * g[1][:, at - 1]
        to = np.stack([out[0] * m[0, 0] + out[1] * m[1, 0], out[0] * m[0, 1] + out[1] * m[1, 1]])
        before[:, at] = to / to.sum(0)
    for j in range(int(count[0]) - 1, 0, -1):
        at = start[: np.searchsorted(-count, -j)] + j
        out = g[:, 0, at] * behind[0, at] + g[:, 1, at] * behind[1, at]
        to = np.stack([m[0, 0] * out[0] + m[0, 1] * out[1], m[1, 0] * out[0] + m[1, 1] * out[1]])
        behind[:, at - 1] = to / to.sum(0)
    f = np.zeros((steps, 2, n))
    f[0, 0], f[0, 1] = before[0], before[1] * e[0]
    f[0] /= f[0].sum(0)
    for t in range(1, steps):
        p = f[t - 1]
        f[t, 0] = p[0] * m[0, 0] + p[1] * m[1, 0]
        f[t, 1] = (p[0] * m[0, 1] + p[1] * m[1, 1]) * e[t]
        f[t] /= f[t].sum(0)
    out = np.zeros((steps, n))
    b0, b1 = behind
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            live = valid[t + 1]
            c1 = b1 * e[t + 1]
            n0, n1 = m[0, 0] * b0 + m[0, 1] * c1, m[1, 0] * b0 + m[1, 1] * c1
            s = n0 + n1
            b0, b1 = np.where(live, n0 / s, b0), np.where(live, n1 / s, b1)
        num = f[t, 1] * b1
        out[t] = num / (num + f[t, 0] * b0)
    return out


def text_start(text: str) -> int:
    """Characters before a text's first word."""
    return len(text) - len(text.lstrip(" \t\n\v\f\r"))


def runs(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: np.ndarray) -> list[dict]:
    """Stretches of words with marginals of at least one half, as character offsets."""
    hit = np.flatnonzero(p >= 0.5)
    out: list[dict] = []
    for group in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []:
        out.append({"start": int(chars[starts[group[0]]]), "end": int(chars[ends[group[-1]]]), "p": float(p[group].mean())})
    return out


def document_scores(model: Crf, texts: pa.Array) -> np.ndarray:
    score = np.zeros(len(texts))
    for a, b, part, s, e, w in parts(texts):
        score[a:b] = calibrated(model, text_marginals(model, part, s, e, w), w)
    return score


def calibrated(model: Crf, p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Document scores from the words' marginals."""
    if model.constant is not None:
        return np.full(len(words) - 1, model.constant)
    return 1 / (1 + np.exp(-np.clip(document_inputs(p, words) @ model.document, -30, 30)))


def score_documents(docs: DataFrame, model: Crf, *, spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, spans (array of start, end, p) of every whole text."""
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]
    if spans:
        kinds.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))))
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, found = np.zeros(batch.num_rows), []
            for a, b, part, s, e, w in parts(batch.column(1)):
                p = text_marginals(model, part, s, e, w)
                score[a:b] = calibrated(model, p, w)
                for r in range(b - a) if spans else ():
                    mine = slice(w[r], w[r + 1])
                    if w[r] < w[r + 1] and p[mine].max() >= 0.5:
                        first = s[w[r]]  # character offsets: bytes that don't continue a character
                        lead = text_start(batch.column(1)[a + r].as_py())
                        chars = np.concatenate([[0], np.cumsum((part[first : e[w[r + 1] - 1]] & 0xC0) != 0x80)]) + lead
                        found.append(runs(p[mine], s[mine] - first, e[mine] - first, chars))
                    else:
                        found.append([])
            cols = [batch.column(0), pa.array(score)] + ([pa.array(found, arrow_spans)] if spans else [])
            yield pa.RecordBatch.from_arrays(cols, [k.name for k in kinds])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, T.StructType(kinds))


def below(docs: DataFrame, model: Crf, limit: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, with all their columns, in one pass."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(document_scores(model, batch.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, limit: tuple[int, int] = TRAINING_ROWS) -> Crf:
    """Fit on at most ``limit`` clean and toxic labelled rows and TRAINING_BYTES of text that aren't held out; the score's constant follows the classes' full counts."""
    session.small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", *limit, most_bytes=TRAINING_BYTES).select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows.column("label").to_numpy().astype(np.int64)
    model = fit(rows.column("text").combine_chunks(), y)
    if model.constant is None:
        full = {r["label"]: r["count"] for r in training_labels(labels, "toxic").groupBy("label").count().collect()}
        model.document[0] += np.log(full[1] / full[0]) - np.log(y.mean() / (1 - y.mean()))
    return model
