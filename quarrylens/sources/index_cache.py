"""A cache of derived tables, each under the fingerprint of its inputs and options.

An entry is a folder index-<fingerprint> with one Parquet table for each part and appears by one rename, so readers see it whole or
not at all and of two writers one wins. An epoch ties a build to the state of the cache when it began: whoever clears the
cache or asks for a rebuild advances it, and builds begun before are thrown away instead of published.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.lookups import evict_oldest
from quarrylens.storage import shared_dir

#: Changes whenever entries of former versions must not be read any more.
FORMAT = "1"


class IndexCache:
    def __init__(self, spark: SparkSession, root: str | None = None, quota: int | None = None):
        """root: a folder that all executors share; quota: bytes that all entries may take, older ones go first."""
        self.spark, self.root, self.quota = spark, (root or f"{shared_dir(spark)}/indexes").rstrip("/"), quota
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path().getFileSystem(self.conf)

    def _path(self, *names: str):
        return self.hadoop.Path("/".join([self.root, *names]))

    # -- keys

    def fingerprint(self, inputs: list[DataFrame], options: dict | None = None) -> str:
        """SHA-256 over options, schemas and every input file's path, size and time; no column of the inputs is read.

        Files are summed up where they are read: two 64-bit hashes and their number for each input, whatever the number of files.
        """
        parts = [FORMAT, json.dumps(options or {}, sort_keys=True)]
        for df in inputs:
            file = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
            sums = [F.sum(F.xxhash64(F.lit(seed), *file.columns).cast("decimal(38,0)")) for seed in (1, 2)]
            parts += [df.schema.json(), *map(str, file.agg(F.count(F.lit(1)), *sums).first())]
        digest = hashlib.sha256()
        for p in parts:
            digest.update(f"{len(p)}:{p}".encode())
        return digest.hexdigest()

    def epoch(self) -> str:
        path = self._path(".epoch")
        return self.spark.read.text(path.toString()).first()[0] if self.files.exists(path) else ""

    def advance_epoch(self) -> str:
        """From now on, builds that have already begun are not published."""
        new = uuid.uuid4().hex
        self.spark.createDataFrame([(new,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(".epoch").toString())
        return new

    # -- entries

    def lookup(self, key: str) -> dict[str, DataFrame] | None:
        """The tables of an entry, or None."""
        path = self._path(f"index-{key}")
        if not self.files.exists(path):
            return None
        tables = [s.getPath() for s in self.files.listStatus(path) if s.isDirectory()]
        return {p.getName(): self.spark.read.parquet(p.toString()) for p in tables}

    def store(self, key: str, epoch: str, write: Callable[[str], None]) -> bool:
        """Publish what write puts into the folder it is given; False if another writer or a newer epoch came first."""
        stage, target = self._path(f".stage-{uuid.uuid4().hex}"), self._path(f"index-{key}")
        self.files.mkdirs(stage)
        try:
            write(stage.toString())
            if self.epoch() != epoch or self.files.exists(target):
                return False
            if self.quota is not None:
                size = self.files.getContentSummary(stage).getLength()
                if size > self.quota:
                    return False
                self.evict(self.quota, size)
            whole = self.files.makeQualified(stage).toUri()
            none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
            try:
                self.hadoop.FileContext.getFileContext(whole, self.conf).rename(self.files.makeQualified(stage), self.files.makeQualified(target), none)
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in str(e.java_exception):
                    return False
                raise
            return True
        finally:
            if self.files.exists(stage):
                self.files.delete(stage, True)

    def get_or_build(self, inputs: list[DataFrame], options: dict, write: Callable[[str], None], rebuild: bool = False) -> dict[str, DataFrame]:
        """The tables for inputs and options, built by write into a folder unless they are there.

        If a newer epoch or the quota keeps the entry from being published, it is built once more outside the cache.
        """
        if rebuild:
            self.drop(self.fingerprint(inputs, options))
            self.advance_epoch()
        epoch, key = self.epoch(), self.fingerprint(inputs, options)
        if (found := self.lookup(key)) is not None:
            return found
        self.store(key, epoch, write)
        if (found := self.lookup(key)) is not None:
            return found
        path = f"{shared_dir(self.spark)}/unpublished-{uuid.uuid4().hex}"
        write(path)
        return {s.getPath().getName(): self.spark.read.parquet(s.getPath().toString()) for s in self.files.listStatus(self.hadoop.Path(path)) if s.isDirectory()}

    def entries(self) -> DataFrame:
        """(key, created, size) of all entries, from one listing."""
        found = [s for s in self.files.listStatus(self._path()) if s.getPath().getName().startswith("index-")] if self.files.exists(self._path()) else []
        rows = [(s.getPath().getName().removeprefix("index-"), s.getModificationTime(), self.files.getContentSummary(s.getPath()).getLength()) for s in found]
        return self.spark.createDataFrame(rows, "key string, created long, size long")

    def evict(self, limit: int, incoming: int = 0) -> list[str]:
        """Delete the oldest entries until the others and incoming bytes fit the limit; their keys."""
        gone = [r["key"] for r in evict_oldest(self.entries(), ["created", "key"], "size", limit, incoming).collect()]
        for key in gone:
            self.drop(key)
        return gone

    def drop(self, key: str) -> None:
        self.files.delete(self._path(f"index-{key}"), True)

    def clear_stages(self, older_than_s: float = 86_400) -> None:
        """Delete what builds that died have left, if it has not changed for so long."""
        for s in self.files.listStatus(self._path()) if self.files.exists(self._path()) else []:
            if s.getPath().getName().startswith(".stage-") and s.getModificationTime() < (time.time() - older_than_s) * 1000:
                self.files.delete(s.getPath(), True)
