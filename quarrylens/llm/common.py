"""Helpers that the training-data operators share: checked broadcasts, sampling, components, hashes."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.storage import materialise

__all__ = ["arrow_rows", "ascii_lower", "chunks", "connected_components", "hash_pair", "held_out", "keep_without", "kept", "materialise", "release", "releasing", "sample_per_class", "sliced", "small_or_plain", "table"]
#: Ids up to this many rows may be broadcast (16 bytes each); beyond it the joins shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if df, a materialised narrow table, has at most limit rows."""
    return F.broadcast(df) if df.count() <= limit else df


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ascii_lower(text):
    """text with A-Z lower-cased and all else as it is; texts of ASCII alone take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def hash_pair(*columns: str) -> list:
    """h1 and h2: 128 bits of the columns together, by two seeds."""
    return [F.xxhash64(F.lit(seed), *columns).alias(f"h{seed}") for seed in (1, 2)]


def keep_without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in ids (one column doc_id, materialised)."""
    gone = ids.select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(small_or_plain(gone), docs[key] == F.col("__gone_id"), "left_anti")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges (src, dst); component is the smallest id reachable.

    Alternating large-star and small-star rounds. A round keeps at most one edge per node and former
    neighbour, minima are combined before the shuffle, and each round's edges are written to the shared folder.
    """
    edges = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    edges, before = materialise(edges, "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def sample_per_class(rows: DataFrame, label: str, n: int) -> DataFrame:
    """About n rows of each label value (all, if it has fewer): those whose hashed doc_id is below the class's share."""
    share = rows.groupBy(label).agg(F.least(F.lit(1.0), n / F.count(F.lit(1))).alias("__share")).withColumnRenamed(label, "__class")
    picked = rows.join(F.broadcast(share), F.col(label) == F.col("__class"))
    return picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("__share") * (1 << 20)).drop("__class", "__share")


def chunks(texts: list[str], size: int = 2_000_000):
    """Ranges [i, j) of consecutive texts of about size characters together (always at least one text)."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


#: What this Python worker keeps for its next tasks: one thing at a time.
_KEPT: dict = {}


def kept(key, make):
    """make() once a worker, as long as its tasks ask for this key and no other and are not wrapped by releasing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


@contextmanager
def arrow_rows(spark: SparkSession, n: int = 1024):
    """Arrow batches of n rows for what runs inside: with long texts the usual 10,000 fill both sides of every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give freed memory back to the system. A worker lives on beside the JVM and the next stage's workers, and the allocators keep what arrays have left."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run):
    """An Arrow task that starts without what other tasks have kept in its worker and releases its memory when it ends."""

    def task(batches):
        _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def sliced(batches, rows: int = 1024):
    """Arrow batches in slices of so many rows, so that what a task builds from one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
