"""Where intermediate tables go: the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a narrow table may be broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and everything runs on this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: Tables that this process has written by materialise, in order.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; cuts the lineage of iterative plans."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; how many. To be called when no DataFrame that was made before will be read any more."""
    files, gone = spark._jvm.org.apache.hadoop.fs, 0
    while _WRITTEN:
        path = files.Path(_WRITTEN.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if df (materialised) has at most limit rows."""
    return F.broadcast(df) if df.count() <= limit else df
