"""Quality classifier by co-training: one view is the text, the other the page's metadata.

The text view holds hashed words and character trigrams (their shares) beside shares and moments of words, lines and characters; the other one
holds language, source and length class. Both views become vectors of fixed size on the executors. A bounded sample of labelled rows (about FIT_ROWS of each class) and of
unlabelled rows (about POOL) comes to the driver as such vectors. Each round, the logistic regression of either view labels the pool's
documents of which it is surest, in the classes' proportion, for the other view. Then both views' scores are
calibrated and combined by a last logistic regression on scores of labelled rows that come from a co-training without
their fold (FOLDS by place in the sample), and all documents are scored.

Defined cases: null or empty text and null metadata have vectors of their own and are scored; with labels of one class only or none every score is
the share of label 1 (0.5 without labels); repeated rows are scored one by one; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylens.llm.common import held_out, sample_per_class, sliced, table

FIT_ROWS, POOL, ROUNDS, GROWTH, SLOTS = 1500, 4000, 5, 0.05, 64
WORD_SLOTS, GRAM_SLOTS, FOLDS = 192, 64, 3
MARKS = ".,;:!?\"'()-#$%&*@/=_<>[]{}|~^+"
UPPER = re.compile(r"[A-Z]")


def text_view(t: str) -> list[float]:
    """Shares and moments of a text's words, lines and characters, then hashed words and character trigrams."""
    n = max(1, len(t))
    words = t.split()
    m = max(1, len(words))
    lines = [x for x in t.split("\n") if x]
    bag = Counter(words)
    kinds = len(bag)
    slots = np.bincount([crc32(w.encode()) % WORD_SLOTS for w in bag], np.sqrt(list(bag.values())), WORD_SLOTS) / np.sqrt(m) if bag else np.zeros(WORD_SLOTS)
    c = np.frombuffer(t.encode(), np.uint8).astype(np.uint32)
    grams = np.bincount((c[:-2] * 2654435761 + c[1:-1] * 40503 + c[2:] * 977 >> 16) % GRAM_SLOTS, minlength=GRAM_SLOTS) / len(c) if len(c) > 2 else np.zeros(GRAM_SLOTS)
    return [
        np.log1p(len(words)), np.log1p(n / m), kinds / m, kinds / np.sqrt(m), len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)),
        len(UPPER.findall(t)) / n, t.count(" ") / n, t.count("\n") / n, sum(map(t.count, "0123456789")) / n, *[min(1.0, 20 * t.count(c) / n) for c in MARKS],
        *slots, *grams,
    ]


def meta_view(lang, source, n_chars) -> list[float]:
    """Hashed language and source, and the length class that the metadata give."""
    out = [0.0] * (2 * SLOTS + 12)
    out[crc32(f"l{lang}".encode()) % SLOTS] = 1.0
    out[SLOTS + crc32(f"s{source}".encode()) % SLOTS] = 1.0
    out[2 * SLOTS + (min(10, int(np.log2(max(1, n_chars)) / 2)) if n_chars is not None else 11)] = 1.0
    return out


N_TEXT, N_META = len(text_view("")), len(meta_view(None, None, None))


def views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cols = [b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    return np.array([text_view(t or "") for t in cols[0]]).reshape(-1, N_TEXT), np.array([meta_view(*m) for m in zip(*cols[1:], strict=True)]).reshape(-1, N_META)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray | None = None, centre: np.ndarray | float = 0.0) -> np.ndarray:
    """Newton steps of a weighted ridge logistic regression, from beta if given; x has a constant column.

    The ridge pulls towards centre with the weight of three rows (3 / n, 1e-3 at least), so that few rows can't fit many features.
    """
    beta = np.zeros(x.shape[1]) if beta is None else beta.copy()
    ridge = max(1e-3, 3 / len(y))
    for _ in range(40):
        p = sigmoid(x @ beta)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) / w.sum() - ridge * (beta - centre))
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def balanced(y: np.ndarray) -> np.ndarray:
    n1 = max(1, int(y.sum()))
    return np.where(y == 1, 0.5 / n1, 0.5 / max(1, len(y) - n1))


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def cotrain(lab: list[np.ndarray], y: np.ndarray, free: list[np.ndarray], share: float) -> list[np.ndarray]:
    """Coefficients of both views after ROUNDS of labels exchanged over the free rows."""
    given = [dict[int, int](), dict[int, int]()]  # pseudo-labels that each view has been given by the other
    beta = [None, None]
    for r in range(ROUNDS + 1):
        for v in (0, 1):
            at = np.array(sorted(given[v]), int)
            xs = np.concatenate((lab[v], free[v][at]))
            ys = np.concatenate((y, [given[v][i] for i in at]))
            beta[v] = logistic(xs, ys, balanced(ys), beta=beta[v])
        if r == ROUNDS or not len(free[0]):
            break
        for v in (0, 1):
            p = sigmoid(free[v] @ beta[v])
            order = np.argsort(p, kind="stable")
            n = max(1, int(GROWTH * len(p)))
            sure = [(i, 1) for i in order[::-1][: max(1, round(n * share))] if p[i] > 0.9] + [(i, 0) for i in order[: max(1, round(n * (1 - share)))] if p[i] < 0.1]
            for i, k in sure:
                given[1 - v].setdefault(int(i), k)
    return beta


def fit(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> dict:
    """Co-train on labelled (x, y) and the unlabelled pool; views are (text, metadata)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return {"share": share}
    mean, std = x[0].mean(axis=0), x[0].std(axis=0) + 1e-6
    lab = [with_one(np.clip((x[0] - mean) / std, -8, 8)), with_one(x[1])]
    free = [with_one(np.clip((pool[0] - mean) / std, -8, 8)), with_one(pool[1])]
    beta = cotrain(lab, y, free, share)
    raw = np.stack([lab[v] @ beta[v] for v in (0, 1)], axis=1)
    for f in range(FOLDS):
        out = np.arange(len(y)) % FOLDS == f
        if 0 < y[~out].sum() < (~out).sum():
            part = cotrain([z[~out] for z in lab], y[~out], free, share)
            raw[out] = np.stack([lab[v][out] @ part[v] for v in (0, 1)], axis=1)
    return {"share": share, "mean": mean, "std": std, "beta": beta, "mix": logistic(with_one(np.clip(raw, -8, 8)), y, np.ones(len(y)) / len(y), centre=np.array([0.5, 0.5, 0.0]))}


def predict(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combined score and both views' scores."""
    if "beta" not in model:
        return (np.full(len(text), model["share"]),) * 3
    raw = [with_one(np.clip((text - model["mean"]) / model["std"], -8, 8)) @ model["beta"][0], with_one(meta) @ model["beta"][1]]
    both = with_one(np.stack([np.clip(r, -8, 8) for r in raw], axis=1))
    return sigmoid(both @ model["mix"]), sigmoid(raw[0]), sigmoid(raw[1])


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, label, text_view, meta_view) of docs (doc_id, __label, text, lang, source, n_chars)."""

    def run(batches):
        for b in sliced(batches):
            x, z = views(b)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), kind), pa.array(list(z), kind)], names=["doc_id", "label", "x", "z"])

    return docs.mapInArrow(run, "doc_id long, label int, x array<double>, z array<double>")


def fit_on(docs: DataFrame, labels: DataFrame, train) -> dict:
    """Sample labelled rows where train holds and unlabelled rows, and co-train on the driver."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label"))
    picked = sample_per_class(known.where(train), "__label", FIT_ROWS)
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    rows = meta.join(F.broadcast(picked), "doc_id")
    n = max(1, docs.select("doc_id").count())
    some = meta.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < min(1.0, POOL / n) * (1 << 20))
    rows = rows.select("doc_id", "__label", "text", "lang", "source", "n_chars").unionByName(some.join(known.select("doc_id"), "doc_id", "left_anti").withColumn("__label", F.lit(None).cast("int")).select("doc_id", "__label", "text", "lang", "source", "n_chars"))
    found = sorted(vectors(rows).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    take = lambda c, some: np.array([r[c] for r in found if (r["label"] is not None) == some], float).reshape(-1, {"x": N_TEXT, "z": N_META}[c])
    return fit((take("x", True), take("z", True)), np.array([r["label"] for r in found if r["label"] is not None], float), (take("x", False), take("z", False)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs, then quality (0 to 1), quality_text and quality_meta, the scores of the two views."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = ["quality", "quality_text", "quality_meta"]
    kept = [f for f in docs.schema.fields if f.name not in more]

    def run(batches):
        for b in sliced(batches):
            out = predict(shared.value, *views(b))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(f.name)) for f in kept], *[pa.array(o, pa.float64()) for o in out]], names=[*[f.name for f in kept], *more])

    return docs.mapInArrow(run, T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in more]]))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; labels are learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = fit_on(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality").alias("score"), "quality_text", "quality_meta", F.when(F.col("quality") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
