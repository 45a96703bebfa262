"""Tables that are still being written, read as streams; the same transformations serve batches.

A JSON Lines folder is tailed file by file: a writer renames finished files into it, so no half line is read, and a
malformed line fails the stream instead of becoming nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tail_json(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the lines of a folder of JSON Lines files, present and future."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(folder)


def tail_parquet(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of a folder of Parquet files, present and future, with the schema of those present."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows over ts; in a stream, rows later than late are dropped.

    State is one row for each open window and type. Rows with a null ts belong to no window; a ts without zone is read in the session's.
    """
    events = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upsert_sink(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that writes each micro-batch's changed rows under out/batch=N and stops when the input is used up.

    A batch that is run again after a failure overwrites its own folder, so the output holds each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of each key that upsert_sink has written."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")
