"""Toxicity: a linear-chain conditional random field tags offending tokens; its marginals make document scores.

Fit, on a bounded sample: about FIT_DOCS labelled rows of each class (hash sampling), none longer than FIT_CHARS characters.
Words that mark label 1 (document frequency contrast) label the tokens of label-1 documents; on these labelled
tokens a two-state chain (plain, toxic) is trained by gradient ascent on its likelihood. Score: forward-backward
over whole texts; the expected number of toxic tokens, the largest marginal and the length of a document go through
a logistic calibration fitted on the same sample. Offsets of the tokens tagged toxic come back as spans.

Defined cases: null or empty text scores like a text without any toxic token; without labels of both classes
every score is the share of label 1 among the sampled rows (0 if none); repeated rows are scored one by one;
other columns are kept or ignored and never clash, for the results are joined to nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby
from math import exp, lgamma, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylens.llm.common import chunks, held_out, release, releasing, sample_per_class, sliced, table

FIT_DOCS = 2000
FIT_CHARS = 20_000
#: Characters that are in work at a time while fitting and scoring.
FIT_CHUNK = 1_000_000
THRESHOLD = 0.7
CACHE_WORDS = 400_000
#: Letters of a word's beginning, and sketch values by which documents of the sample count as one group of copies.
STEM, SKETCH = 4, 6
#: A mark is in toxic documents at this share (classes weighed alike), too often for chance at this level over all words.
MIN_PRECISION, CHANCE = 0.8, 0.01


@dataclass
class Crf:
    """Words with weights of their own, log potentials (word, state), transitions, start, calibration, prior."""

    words: dict[str, int]
    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    calib: np.ndarray
    prior: float


def core(token: str) -> str:
    """A white-space token without what is not a letter or digit at its ends, in lower case."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j].lower()


def stem(word: str) -> str:
    """The feature a word without a weight of its own falls back to: its first STEM letters, marked."""
    return word[:STEM] + "*" if len(word) >= STEM else ""


class WordIds(dict):
    """Raw token -> index of its word in the model (0: other), filled on demand and emptied when large."""

    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = core(token)
        k = self.words.get(word) or self.words.get(stem(word), 0)
        self[token] = k
        return k


def marginals(ids: np.ndarray, first: np.ndarray, emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward and backward vectors (scaled) of all documents laid end to end; first marks their first tokens.

    A document's first token forgets the state before it, so one chain holds any number of documents. The chain is
    cut into blocks: 2x2 products of all blocks side by side, then from block to block, then inside all blocks.
    """
    n = len(ids)
    width = max(1, int(np.sqrt(n) / 1.5))
    blocks = -(-n // width)
    pad = blocks * width - n
    pot = np.exp(emit - emit.max(axis=1, keepdims=True))[ids]
    pot = np.concatenate([pot, np.ones((pad, 2))]).reshape(blocks, width, 2)
    begins = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, width)
    a, s = np.exp(trans), np.exp(start)

    def step(t: int):  # the 2x2 matrices of position t of each block: m[i][j]
        e, b = pot[:, t], begins[:, t]
        return [[np.where(b, s[j], a[i, j]) * e[:, j] for j in (0, 1)] for i in (0, 1)]

    p = [[np.ones(blocks), np.zeros(blocks)], [np.zeros(blocks), np.ones(blocks)]]
    for t in range(width):
        m = step(t)
        p = [[p[i][0] * m[0][j] + p[i][1] * m[1][j] for j in (0, 1)] for i in (0, 1)]
        z = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[p[i][j] / z for j in (0, 1)] for i in (0, 1)]
    prod = np.array(p).transpose(2, 0, 1)
    fore, back = np.empty((blocks, 2)), np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        fore[b] = v
        v = v @ prod[b]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1):
        back[b] = v
        v = prod[b] @ v
        v = v / v.sum()
    alpha, beta = np.empty((blocks, width, 2)), np.empty((blocks, width, 2))
    v0, v1 = fore[:, 0], fore[:, 1]
    for t in range(width):
        m = step(t)
        v0, v1 = v0 * m[0][0] + v1 * m[1][0], v0 * m[0][1] + v1 * m[1][1]
        z = v0 + v1
        v0, v1 = v0 / z, v1 / z
        alpha[:, t, 0], alpha[:, t, 1] = v0, v1
    v0, v1 = back[:, 0], back[:, 1]
    for t in range(width - 1, -1, -1):
        beta[:, t, 0], beta[:, t, 1] = v0, v1
        m = step(t)
        v0, v1 = m[0][0] * v0 + m[0][1] * v1, m[1][0] * v0 + m[1][1] * v1
        z = v0 + v1
        v0, v1 = v0 / z, v1 / z
    alpha, beta = alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]
    gamma = alpha * beta
    return alpha, beta, gamma / gamma.sum(axis=1, keepdims=True)


def expected(ids: np.ndarray, first: np.ndarray, params: list[np.ndarray]) -> list[np.ndarray]:
    """Expected numbers of (word, state), (state, next state) and first states."""
    alpha, beta, gamma = marginals(ids, first, *params)
    inner = np.flatnonzero(~first)
    pot = np.exp(params[0] - params[0].max(axis=1, keepdims=True))[ids[inner]]
    pair = alpha[inner - 1][:, :, None] * np.exp(params[1])[None] * (pot * beta[inner])[:, None, :]
    words = np.stack([np.bincount(ids, gamma[:, j], len(params[0])) for j in (0, 1)], axis=1)
    return [words, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0), gamma[first].sum(axis=0)]


def lay_out(texts: list[str], ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts end to end, marks of first tokens, and each text's number of tokens."""
    flat: list[int] = []
    counts = np.empty(len(texts), np.int64)
    get = ids.__getitem__
    for k, t in enumerate(texts):
        words = t.split()
        flat += map(get, words)
        counts[k] = len(words)
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return np.fromiter(flat, np.int32, len(flat)), first, counts


def evidence(gamma: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document 1, log(1 + expected toxic tokens), surety of the largest marginal, log(1 + tokens): chance hits grow with length."""
    out = np.zeros((len(counts), 4))
    out[:, 0], out[:, 3] = 1, np.log1p(counts)
    full = counts > 0
    if full.any():
        at = (np.cumsum(counts) - counts)[full]
        out[full, 1] = np.log1p(np.add.reduceat(gamma[:, 1], at))
        out[full, 2] = -np.log(1.001 - np.maximum.reduceat(gamma[:, 1], at))  # one sure token outweighs length
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def copies(texts: list[str]) -> list[int]:
    """A group number for each text; texts that share one of their smallest shingle hashes are one group."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    owner: dict[int, int] = {}
    for i, t in enumerate(texts):
        w = t.split()
        for h in sorted({crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))})[:SKETCH]:
            parent[root(i)] = root(owner.setdefault(h, i))
    return [root(i) for i in range(len(texts))]


def tail(k: int, n: int, p: float) -> float:
    """Chance of k or more successes in n draws of chance p."""
    return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k, n + 1))


def fit(texts: list[str], labels: list[int], rounds: int = 60) -> Crf:
    """Train the chain and its calibration on the sampled texts."""
    y = np.array(labels, dtype=int)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    prior = n1 / len(y) if len(y) else 0.0
    empty = Crf({}, np.zeros((1, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(4), prior)
    if not n1 or not n0:
        return empty
    group = copies(texts)  # a group of copies counts once, or its ordinary words would mark its label
    seen, docs = (Counter(), Counter()), [0, 0]
    # One group's words at a time: the words of all texts together take many times the memory of the texts.
    order = sorted(range(len(texts)), key=lambda i: (y[i], group[i]))
    for (k, _), members in groupby(order, key=lambda i: (int(y[i]), group[i])):
        found: set[str] = set()
        for i in members:
            for w in {core(w) for w in texts[i].split()}:
                found |= {w, stem(w)}
        docs[k] += 1
        seen[k].update(found - {""})
    marks, share = set(), docs[1] / (docs[0] + docs[1])
    known = [w for w in sorted(set(seen[1]) | set(seen[0])) if seen[0][w] + seen[1][w] >= 3]
    for w in known:
        c1, c0 = seen[1][w], seen[0][w]
        r1, r0 = c1 / docs[1], c0 / docs[0]
        if c1 and r1 / (r1 + r0) >= MIN_PRECISION and tail(c1, c1 + c0, share) * len(known) <= CHANCE:
            marks.add(w)
    # Of the words that mark nothing only the frequent ones have weights of their own.
    common = {w for w, _ in (seen[0] + seen[1]).most_common(2000)}
    kept = [w for w in known if w in marks or w in common]
    toxic_word = np.array([False] + [w in marks for w in kept])
    words = {w: k + 1 for k, w in enumerate(kept)}
    emit, trans, start = np.zeros((len(words) + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    params = [emit, trans, start]
    want, freq, n_inner, n_first = [np.zeros_like(p) for p in params], np.zeros(len(words) + 1), 0, 0
    known_ids, parts = WordIds(words), []
    for i, j in chunks(texts, FIT_CHUNK):  # documents are independent, so the sample goes through in parts of bounded size
        ids, first, counts = lay_out(texts[i:j], known_ids)
        parts.append((ids, first, counts))
        tag = (toxic_word[ids] & np.repeat(y[i:j] == 1, counts)).astype(int)
        inner = np.flatnonzero(~first)
        np.add.at(want[0], (ids, tag), 1)
        np.add.at(want[1], (tag[inner - 1], tag[inner]), 1)
        np.add.at(want[2], (tag[first],), 1)
        freq += np.bincount(ids, minlength=len(freq))
        n_inner, n_first = n_inner + len(inner), n_first + int(first.sum())
    if not n_first:
        return empty
    scale = [np.maximum(freq, 1)[:, None] + 5.0, max(1, n_inner), max(1, n_first)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        got = [np.zeros_like(p) for p in params]
        for ids, first, _ in parts:
            if len(ids):
                for total, part in zip(got, expected(ids, first, params), strict=True):
                    total += part
        for q in range(3):
            g = (want[q] - got[q]) / scale[q] - 1e-3 * params[q]
            m1[q] = 0.8 * m1[q] + 0.2 * g
            m2[q] = 0.95 * m2[q] + 0.05 * g * g
            params[q] += 0.2 * (m1[q] / (1 - 0.8**k)) / (np.sqrt(m2[q] / (1 - 0.95**k)) + 1e-6)
    x = np.concatenate([evidence(marginals(ids, first, *params)[2] if len(ids) else np.zeros((0, 2)), counts) for ids, first, counts in parts])
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    calib = np.zeros(4)
    for _ in range(60):  # Newton steps of a weighted logistic regression with a slight ridge
        p = sigmoid(x @ calib)
        grad = x.T @ (weight * (y - p)) - 1e-4 * calib
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        calib = calib + step
        if np.abs(step).max() < 1e-8:
            break
    return Crf(words, *params, calib, prior)


def score_texts(texts: list[str], model: Crf, ids: WordIds) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores of texts and their offending spans (start, end, marginal) in code points."""
    scores, spans = np.full(len(texts), model.prior), [[] for _ in texts]
    if not model.words:
        return scores, spans
    for i, j in chunks(texts, FIT_CHUNK):
        flat, first, counts = lay_out(texts[i:j], ids)
        if not len(flat):
            scores[i:j] = sigmoid(evidence(np.zeros((0, 2)), counts) @ model.calib)
            continue
        gamma = marginals(flat, first, model.emit, model.trans, model.start)[2]
        scores[i:j] = sigmoid(evidence(gamma, counts) @ model.calib)
        at = np.cumsum(counts) - counts
        hot = np.flatnonzero(gamma[:, 1] >= 0.5)
        of = np.searchsorted(at + counts, hot, side="right")
        for k in np.unique(of):
            mine = {int(h - at[k]): float(gamma[h, 1]) for h in hot[of == k]}
            for w, m in enumerate(re.finditer(r"\S+", texts[i + k])):
                if w in mine:
                    spans[i + k].append((m.start(), m.end(), round(mine[w], 6)))
    return scores, spans


def fit_on(docs: DataFrame, labels: DataFrame, train) -> Crf:
    """Sample labelled rows where train holds and fit on the driver (bounded by FIT_DOCS and FIT_CHARS)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    picked = sample_per_class(known.where(train), "__toxic", FIT_DOCS)
    rows = docs.where(F.length("text") <= FIT_CHARS).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "__toxic")
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    texts, marks = [r["text"] for r in rows], [r["__toxic"] for r in rows]
    del rows
    model = fit(texts, marks)
    del texts
    release()  # the driver goes on after the fit, and would keep what the sample has taken
    return model


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """All columns of docs, then toxicity (double, 0 to 1) and toxic_spans array<struct<start, end, p>>."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("toxicity", "toxic_spans")] + [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", span)])
    kept = [f.name for f in schema.fields[:-2]]
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        own = Crf(*shared.value)
        ids = WordIds(own.words)
        for b in sliced(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores, spans = score_texts(texts, own, ids)
            found = pa.array([[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans], arrow_span)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(scores), found], names=kept + ["toxicity", "toxic_spans"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(releasing(run), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs.select("doc_id", "text"), model)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), spans.alias("spans"))
