"""Snapshots of a class index: the directory apart from the members, in blocks whose digests are checked before they are read.

The directory (name, kind, flags, inner) is a table of its own, so listing classes reads nothing of their members. Each file is a block of bounded
rows; its SHA-256 and length stand in a table written last, without which a snapshot doesn't count as whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DIRECTORY = ["name", "kind", "flags", "inner"]
#: Rows of a block; a block is read as a whole when its digest is checked.
BLOCK_ROWS = 100_000


class DamagedSnapshot(ValueError):
    """Blocks that are missing, changed or not listed."""


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(block, length, digest) of the files of a snapshot, worked out where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{path}/directory", f"{path}/members"])
    return files.select(F.regexp_extract("path", "((?:directory|members)/[^/]*)$", 1).alias("block"), "length", F.sha2("content", 256).alias("digest"))


def write(index: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write a class index (DIRECTORY and any other columns) as a snapshot; rows go in order of name."""
    rows = index.repartitionByRange("name").sortWithinPartitions("name")
    members = [c for c in index.columns if c not in DIRECTORY or c == "name"]
    for part, columns in (("directory", [c for c in DIRECTORY if c in index.columns]), ("members", members)):
        rows.select(columns).write.option("maxRecordsPerFile", block_rows).parquet(f"{path}/{part}")
    # Digests are worked out where the blocks are read; only their rows meet.
    digests(index.sparkSession, path).repartition(1).write.parquet(f"{path}/blocks")


def damage(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """(block, fault): blocks that are missing, changed or extra; of one part only, if it is given."""
    said, found = spark.read.parquet(f"{path}/blocks"), digests(spark, path)
    both = said.select("block", F.col("length").alias("l"), F.col("digest").alias("d")).join(found, "block", "full")
    fault = F.when(F.col("digest").isNull(), "missing").when(F.col("d").isNull(), "not listed").when((F.col("l") != F.col("length")) | (F.col("d") != F.col("digest")), "changed")
    return both.select("block", fault.alias("fault")).where(F.col("fault").isNotNull() & (F.lit(part is None) | F.col("block").startswith(f"{part}/")))


def read(spark: SparkSession, path: str, part: str | None = None, check: bool = True) -> DataFrame:
    """A snapshot's directory, members, or both joined by name; raises DamagedSnapshot, naming the blocks, if a digest is wrong."""
    if check and (bad := damage(spark, path, part).orderBy("block").limit(10).collect()):
        raise DamagedSnapshot(", ".join(f"{r['block']}: {r['fault']}" for r in bad))
    if part:
        return spark.read.parquet(f"{path}/{part}")
    return spark.read.parquet(f"{path}/directory").join(spark.read.parquet(f"{path}/members"), "name")
