"""Language identification by a string kernel: blended-spectrum presence kernel, Nystroem landmarks, ridge regression.

Kernel: k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y), n-grams of 1 to ORDERS bytes of UTF-8 counted by
presence, hashed to SLOTS. A bounded sample of learnable rows (about FIT_ROWS at most, spread over the languages, by hash sampling) comes
to the driver as presence bitmaps of fixed size. LANDMARKS of them span the Nystroem map k(x, landmarks) K^(-1/2);
one ridge regression for each language is fitted on it. Since the kernel is linear in the presence vector, landmarks, map and
weights multiply to one matrix (slots x languages); whole texts are scored by batched products with it.

Defined cases: null text or text without a letter is `und` with score 0; without learnable rows every
text is `und`; equal scores go to the first language in order; repeated rows are scored one by one; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylens.llm.common import held_out, table, sample_per_class

ORDERS, SLOTS = 4, 1 << 15
FIT_ROWS, PER_LANGUAGE, LANDMARKS, RIDGE = 3000, 400, 300, 1e-2
ROWS = 128
UNKNOWN = "und"
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def presence(texts: list[bytes]) -> np.ndarray:
    """For each text a row of SLOTS flags: which hashed n-grams occur."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    shift = np.uint32(32 - (SLOTS.bit_length() - 1))
    for row, t in zip(out, texts, strict=True):
        data = np.frombuffer(t, np.uint8)
        for a in range(0, len(data), 1 << 20):  # long texts go piece by piece, overlapping by ORDERS - 1 bytes
            piece = data[a : a + (1 << 20) + ORDERS - 1].astype(np.uint32)
            code = piece
            for n in range(ORDERS):
                if n:
                    code = (code[:-1] << np.uint32(8)) | piece[n:]
                row[((code + np.uint32(n + 1)) * FACTORS[n]) >> shift] = 1
    return out


def fit(bits: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, slots x languages matrix) from packed presence rows."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((SLOTS, 0), np.float32)
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in bits]), axis=1).astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
    x /= norm[:, None]
    # Landmarks: the languages in turn, each in the order of the sample.
    turn = [sum(langs[j] == langs[i] for j in range(i)) for i in range(len(langs))]
    marks = sorted(range(len(langs)), key=lambda i: (turn[i], langs[i]))[:LANDMARKS]
    k = (x @ x[marks].T).astype(np.float64)
    values, vectors = np.linalg.eigh(k[marks])
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([langs.count(n) for n in langs], float)
    weight = len(langs) / (len(names) * share)
    mean = (weight[:, None] * phi).sum(axis=0) / weight.sum()
    gram = (phi - mean).T @ ((phi - mean) * weight[:, None]) + RIDGE * len(langs) * np.eye(phi.shape[1]) / 100
    middle = (weight[:, None] * y).sum(axis=0) / weight.sum()
    w = np.linalg.solve(gram, (phi - mean).T @ ((y - middle) * weight[:, None]))
    matrix = x[marks].T.astype(np.float64) @ (root @ w)
    bias = middle - mean @ w
    return names, np.concatenate((matrix, bias[None])).astype(np.float32)


def scores(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Decision value of each text and language: batches of presence rows times the matrix."""
    out = np.empty((len(texts), matrix.shape[1]), np.float32)
    for i in range(0, len(texts), ROWS):
        x = presence(texts[i : i + ROWS]).astype(np.float32)
        out[i : i + ROWS] = (x @ matrix[:-1]) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) + matrix[-1]
    return out


def as_bytes(column) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def fit_on(docs: DataFrame, learnable) -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of the rows of docs where learnable holds and lang is not null."""
    names = docs.where(learnable & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("__lang"))
    n = names.select("__lang").distinct().count()
    if not n:
        return fit([], [])
    picked = sample_per_class(names.where("doc_id is not null"), "__lang", max(1, min(PER_LANGUAGE, FIT_ROWS // n)))
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "__lang")

    def pack(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i in range(0, len(texts), ROWS):
                bits = np.packbits(presence(texts[i : i + ROWS]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + ROWS], b.column(2)[i : i + ROWS], pa.array([r.tobytes() for r in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    found = sorted(rows.mapInArrow(pack, T.StructType([rows.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("bits", T.BinaryType())])).collect(), key=lambda r: (r["doc_id"], r["bits"]))
    return fit([bytes(r["bits"]) for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """All columns of docs, then lang_pred string and lang_score double (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "__letters")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        langs, matrix = shared.value
        for b in batches:
            known = b.column(b.num_columns - 1).to_pylist()
            texts = [t if k else b"" for t, k in zip(as_bytes(b.column(b.schema.names.index("text"))), known, strict=True)]
            if langs:
                s = scores(texts, matrix)
                best = s.argmax(axis=1)
                value = np.clip((s[np.arange(len(s)), best].astype(float) + 1) / 2, 0, 1)
                found = [(langs[i], v) if k else (UNKNOWN, 0.0) for i, v, k in zip(best.tolist(), value.tolist(), known, strict=True)]
            else:
                found = [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "lang_score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    return docs.select(*names, letters).mapInArrow(run, schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs.select("doc_id", "text", "lang"), ~held_out())
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
