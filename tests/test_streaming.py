"""Streams over growing folders give what a batch over all their files gives."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from quarrylens.streaming import tail


def rows(df):
    return sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())


def test_windows_of_a_growing_folder(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    first, second = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    for part in (first, second):
        part.write.mode("append").parquet(folder)
        stream = tail.window_counts(tail.tail_parquet(spark, folder, 1), "1 day", "3650 days")
        tail.upsert_sink(stream, out, mark).awaitTermination()
    want = rows(tail.window_counts(spark.read.parquet(folder), "1 day"))
    assert want and rows(tail.latest(spark, out, ["window_start", "event_type"])) == want


def test_malformed_line_fails(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"name": "A", "flags": 1}) + "\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    tail.upsert_sink(tail.tail_json(spark, str(folder), "name string, flags int"), out, mark).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).select("name", "flags").collect()] == [("A", 1)]
    (folder / "b.json").write_text('{"name": "B", "fl\n')
    with pytest.raises(StreamingQueryException):
        tail.upsert_sink(tail.tail_json(spark, str(folder), "name string, flags int"), out, mark).awaitTermination()
