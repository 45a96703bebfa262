"""Near-duplicate embeddings by sorted projection passes.

Rows with equal label and vector are one vector with a multiplicity, which enters the links and components of all of them.
In each of PASSES passes the vectors of a label are ordered by the signs of their projections on BITS random directions,
read as one word. Blocks of BLOCK neighbours in that order are compared with themselves and with the block before,
by cosine in double precision. Vectors whose first RUN_BITS signs agree are a run; if it spans more than two blocks, its
blocks are all compared with one another, so a dense cluster is never cut by the size of a block.
A pair that an earlier pass has already compared is skipped, so each link counts once.
A block hands on, for each vector, its number of links and the root of its group in the block; roots are joined to
components over all passes. Two vectors with cosine >= 0.98 differ in a sign with chance 0.064 at most, so they share a run in
one of ten passes with chance 1 - (1 - 0.936 ** 20) ** 10 = 0.95 at least, whatever stands around them; blocks find others.

Defined cases: a null label, or a vector that is null, empty, zero or holds null or non-finite components links with nothing;
vectors of different length never link; of several rows with one vec_id the smallest (label, vector) counts; a null
vec_id keeps one row without links; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm.common import connected_components, materialise, small_or_plain, table

COSINE, PASSES, BITS, BLOCK, RUN_BITS, SEED = 0.98, 10, 48, 1024, 20, 20240607


def usable(vector) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def keys(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, pass, key) of usable vectors."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            vectors = [None if v.as_py() is None or None in v.as_py() else np.array(v.as_py(), float) for v in b.column(2)]
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if usable(v):
                    by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, PASSES * BITS))
                signs = (np.stack([vectors[i] for i in at]) @ planes[dim] > 0).reshape(len(at), PASSES, BITS)
                key = (signs * weights).sum(axis=2)
                n = len(at) * PASSES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([ids[i] for i in at], PASSES)), pa.array(np.repeat([labels[i] for i in at], PASSES)), pa.array(np.full(n, dim, np.int64)), pa.array(np.tile(np.arange(PASSES, dtype=np.int64), len(at))), pa.array(key.ravel())],
                    names=["vec_id", "label", "dim", "pass", "key"],
                )

    return rows.mapInArrow(run, "vec_id long, label long, dim long, pass long, key long")


def with_blocks(found: DataFrame) -> DataFrame:
    """(vec_id, blocks, first, last): each vector's block in each pass, counted over the whole order, and where its run spans
    more than two blocks, the run's first and last block (else -1)."""
    run = ["pass", "label", "dim", "run"]
    ordered = found.repartitionByRange("pass", "label", "dim", "key", "vec_id").sortWithinPartitions("pass", "label", "dim", "key", "vec_id")
    ordered = materialise(ordered.select("vec_id", "pass", "label", "dim", F.shiftright("key", BITS - RUN_BITS).alias("run"), F.monotonically_increasing_id().alias("at")), "order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    base, rows = 0, []
    for p, n in sizes:
        rows.append((p, base))
        base += -(-n // BLOCK)
    if not rows:
        none = F.array(F.lit(0).cast("long"))
        return ordered.select("vec_id", none.alias("blocks"), none.alias("first"), none.alias("last")).where("false")
    start = ordered.sparkSession.createDataFrame(rows, "part long, base long")
    ordered = ordered.withColumn("part", part).join(F.broadcast(start), "part").withColumn("block", F.col("base") + F.floor(row / BLOCK))
    long = ordered.groupBy(*run).agg(F.min("block").alias("first"), F.max("block").alias("last")).where("last - first > 1")
    ordered = ordered.join(small_or_plain(materialise(long, "runs")), run, "left")
    pick = lambda c: F.array(*[F.max(F.when(F.col("pass") == p, F.coalesce(F.col(c), F.lit(-1).cast("long")))) for p in range(PASSES)])
    return ordered.groupBy("vec_id").agg(pick("block").alias("blocks"), pick("first").alias("first"), pick("last").alias("last"))


def linked(rows: DataFrame) -> DataFrame:
    """(vec_id, n, root): links of each vector first compared in one block of one pass, and its group's root there.

    rows: (pass, block, other, own, vec_id, label, times, blocks, first, embedding); own is false for the block before. Where other
    is a block number, both blocks lie in one run and only own rows with the others are compared.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "vec_id"], ascending=[False, True])
        dims = pdf["embedding"].str.len().to_numpy()
        counts, roots = [], []
        for dim in np.unique(dims):
            sub = pdf[dims == dim]
            x = np.stack(sub["embedding"].to_numpy()).astype(float)
            norm = np.sqrt((x * x).sum(axis=1))
            ids, label, own = sub["vec_id"].to_numpy(), sub["label"].to_numpy(), sub["own"].to_numpy()
            blocks, this = np.stack(sub["blocks"].to_numpy()), int(sub["pass"].iloc[0])
            first, times = np.stack(sub["first"].to_numpy()), sub["times"].to_numpy()
            m = int(own.sum())
            cos = (x[:m] @ x.T) / (norm[:m, None] * norm[None, :])
            i, j = np.nonzero(cos >= COSINE)
            ok = (i < j) & (label[i] == label[j])
            if sub["other"].iloc[0] >= 0:
                ok &= j >= m
            i, j = i[ok], j[ok]
            if this and len(i):
                met = (np.abs(blocks[i, :this] - blocks[j, :this]) <= 1) | ((first[i, :this] >= 0) & (first[i, :this] == first[j, :this]))
                new = ~met.any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            parent = np.arange(len(ids))
            while True:  # smallest index of each group, by repeated minima over its links
                low = parent.copy()
                np.minimum.at(low, i, parent[j])
                np.minimum.at(low, j, parent[i])
                low = low[low]
                if (low == parent).all():
                    break
                parent = low
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, times[j])
            np.add.at(n, j, times[i])
            hit = n > 0
            counts.append(pd.DataFrame({"vec_id": ids[hit], "n": n[hit], "root": ids[parent[hit]]}))
        return pd.concat(counts) if counts else pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    return rows.groupBy("pass", "block", "other").applyInPandas(compare, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    copy = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", "label").alias("h2")]  # 128 bits name a (label, vector)
    rows = materialise(rows.select("*", *copy), "vectors")
    clean = rows.where("vec_id is not null and label is not null")
    groups = materialise(clean.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times")), "copies")
    clean = clean.join(groups.select("vec_id", "times"), "vec_id").select("vec_id", "label", "embedding", "times")
    blocks = materialise(with_blocks(keys(clean)), "blocks")
    near, far = F.lit(-1).cast("long"), lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    deal = lambda p, block, other, own: F.struct(F.lit(p).cast("long").alias("pass"), block.alias("block"), other.alias("other"), F.lit(own).alias("own"))
    deals = []
    for p in range(PASSES):
        block, first, last = F.get("blocks", p), F.get("first", p), F.get("last", p)
        deals.append(F.array(deal(p, block, near, True), deal(p, block + 1, near, False)))
        deals.append(F.when(first >= 0, F.transform(far(first, block - 2), lambda o: deal(p, block, o, True))).otherwise(F.array()))  # noqa: B023
        deals.append(F.when(first >= 0, F.transform(far(block + 2, last), lambda b: deal(p, b, block, False))).otherwise(F.array()))  # noqa: B023
    dealt = clean.join(blocks, "vec_id").select("vec_id", "label", "times", "embedding", "blocks", "first", F.explode(F.concat(*deals)).alias("d"))
    found = materialise(linked(dealt.select("d.*", "vec_id", "label", "times", "blocks", "first", "embedding")), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("id", "vec_id")
    usable_ids = blocks.select("vec_id")  # the others link with nothing, not even with their copies
    verdict = groups.join(usable_ids, "vec_id").join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    verdict = verdict.select("h1", "h2", "vec_id", "times", (F.coalesce("n", F.lit(0).cast("long")) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    verdict = materialise(verdict, "verdict")
    single = verdict.where("times = 1").select("vec_id", F.col("n_links").alias("n1"), F.col("component_id").alias("c1"))
    several = small_or_plain(materialise(verdict.where("times > 1").select("h1", "h2", F.col("n_links").alias("n2"), F.col("component_id").alias("c2")), "verdict"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("h1")).alias("h1"), "h2")
    out = out.join(single, "vec_id", "left").join(several, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n1", "n2", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c1", "c2", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
