"""Bucketed warehouses, snapshots with digests, generations and keyed state."""

import time
from concurrent.futures import CancelledError
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarrylens import storage
from quarrylens.operators import references
from quarrylens.sources import snapshot
from quarrylens.sources.warehouse import Warehouse
from quarrylens.streaming import tail
from quarrylens.streaming.sessions import Generations, last_writer


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_warehouse_appends_and_joins_without_a_shuffle(spark, tmp_path):
    nodes = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "node_id long, name string")
    edges = lambda *pairs: spark.createDataFrame(pairs, "src_id long, dst_id long")
    store = Warehouse(spark, f"w{time.time_ns()}", 4, str(tmp_path / "tables"))
    count = lambda df: {r["relation"]: r["n"] for r in df.collect()}
    assert count(store.append(nodes(1, 2, 2, 3), edges((1, 2), (1, 2), (2, 3)))) == {"nodes": 3, "edges": 2}
    assert count(store.append(nodes(3, 4), edges((2, 3), (1, 4), (4, 4)))) == {"nodes": 4, "edges": 4}
    assert count(store.append(nodes(3, 4), edges((2, 3), (1, 4), (4, 4)))) == {"nodes": 4, "edges": 4}  # run again
    assert sorted(map(tuple, store.degrees().collect())) == [(1, 2, 0), (2, 1, 1), (3, 0, 1), (4, 1, 2)]
    assert sorted(map(tuple, store.callees().collect())) == [(1, 2, "n2"), (1, 4, "n4"), (2, 3, "n3"), (4, 4, "n4")]
    assert not exchanges(store.degrees()) and not exchanges(store.callees())
    store.drop()
    assert store.sizes() == {}


def test_snapshot_reads_its_directory_alone_and_notices_damage(spark, tmp_path):
    def written(name, width):
        rows = spark.range(300).select(F.format_string("C%04d", "id").alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("flags"), F.lit(False).alias("inner"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.sha2(F.concat(F.col("id"), i), 256)).alias("methods"))
        snapshot.write(rows, str(tmp_path / name), 100)
        return str(tmp_path / name)

    small, large = written("small", 1), written("large", 200)
    size = lambda path, part: sum(p.stat().st_size for p in Path(path, part).glob("*.parquet"))
    assert size(small, "directory") == size(large, "directory") and size(large, "members") > 20 * size(small, "members")
    plan = snapshot.read(spark, large, "directory")
    assert plan.count() == 300 and all("/directory/" in f for f in plan.inputFiles())
    assert snapshot.read(spark, large).count() == 300
    block = sorted(Path(large, "members").glob("*.parquet"))[0]
    data = bytearray(block.read_bytes())
    data[len(data) // 2] ^= 1
    block.write_bytes(bytes(data))
    (block.parent / f".{block.name}.crc").unlink(missing_ok=True)
    with pytest.raises(snapshot.DamagedSnapshot, match=f"{block.name}: changed"):
        snapshot.read(spark, large)
    assert snapshot.read(spark, large, "directory").count() == 300  # its own blocks are whole
    block.unlink()
    with pytest.raises(snapshot.DamagedSnapshot, match="missing"):
        snapshot.read(spark, large, "members")


def test_a_newer_question_stops_the_older(spark):
    ask = Generations(spark)

    @F.udf("long")
    def slow(x):
        time.sleep(30)
        return x

    began = time.time()
    first = ask.ask(lambda: spark.range(8).select(slow("id")).collect())
    while not spark.sparkContext.statusTracker().getActiveStageIds() and time.time() - began < 20:
        time.sleep(0.1)
    second = ask.ask(lambda: spark.range(5).count())
    with pytest.raises(CancelledError):
        first.result(timeout=20)
    assert second.result(timeout=60) == 5 and ask.generation == 2
    third = ask.ask(lambda: spark.range(8).select(slow("id")).collect())
    time.sleep(1)
    ask.cancel()
    with pytest.raises(CancelledError):
        third.result(timeout=20)
    failed = ask.ask(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(timeout=20)
    done = time.time()
    while spark.sparkContext.statusTracker().getActiveStageIds() and time.time() - done < 20:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveStageIds() and time.time() - began < 60


def test_keyed_state_restarts_in_the_middle_of_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: last_writer(tail.tail_parquet(spark, folder, 1), "user_id", ["ts", "event_id"])

    def breaks(batch, number):
        (batch.limit(3) if number == 1 else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1:
            raise RuntimeError("the driver is lost here")

    query = stream().writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(breaks)
    with pytest.raises(StreamingQueryException):
        query.start().awaitTermination()
    tail.upsert_sink(stream(), out, mark).awaitTermination()
    got = references.latest(spark.read.parquet(out), "user_id", "batch").select("user_id", "event_id", "event_type")
    want = last_writer(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_intermediate_tables_can_be_cleared(spark):
    path = storage.materialise(spark.range(3), "tmp").inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and storage.clear(spark) >= 1 and not Path(path).exists()
    assert storage.clear(spark) == 0


def test_snapshot_blocks_are_digested_by_several_tasks(spark, tmp_path):
    """Only the digests' rows go to one task, not the blocks."""
    path, tasks = str(tmp_path / "s"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("snapshot", "snapshot")
    snapshot.write(spark.range(4000).select(F.format_string("c%05d", "id").alias("name"), F.lit("class").alias("kind"), F.lit(0).alias("flags"), (F.col("id") < 0).alias("inner"), F.array("id").alias("methods")), path, 100)
    stages = [tasks.getStageInfo(s) for j in tasks.getJobIdsForGroup("snapshot") for s in tasks.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    newest = max((s for s in stages if s and s.numTasks), key=lambda s: s.stageId)
    before = [s for s in stages if s and s.stageId == newest.stageId - 1]
    assert newest.numTasks == 1 and before and before[0].numTasks > 1
