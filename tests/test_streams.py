"""Streams: a log with commits under failing tasks and replays, state in place across restarts, windows and late rows."""

import json
import os
import subprocess
import sys
import textwrap
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from gradeflow.sources import records
from gradeflow.streaming import progress, state
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def log_source(spark):
    spark.dataSource.register(records.Records)


def ids(spark, uri, schema="id long"):
    return sorted(r.id for r in records.read(spark, uri, spark.createDataFrame([], schema).schema).collect())


def test_a_log_of_several_writes(spark, log_source, tmp_path):
    uri = str(tmp_path / "log")
    assert ids(spark, uri) == []
    spark.range(100).write.format("records").mode("append").save(uri)
    spark.range(100, 110).repartition(3).write.format("records").mode("append").save(uri)
    spark.range(0).write.format("records").mode("append").save(uri)
    assert ids(spark, uri) == list(range(110)) and [c["records"] for c in records.commits(uri)] == [100, 10, 0]
    spark.range(5).write.format("records").mode("overwrite").save(uri)
    spark.range(7, 9).write.format("records").mode("append").save(uri)
    assert ids(spark, uri) == [0, 1, 2, 3, 4, 7, 8]


def test_a_write_that_fails_is_not_seen(spark, log_source, tmp_path):
    uri = str(tmp_path / "log")
    spark.range(10).write.format("records").mode("append").save(uri)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("records").mode("append").save(uri)
    assert ids(spark, uri) == list(range(10)) and len(records.commits(uri)) == 1
    for path in records.orphans(uri, older=-60):
        Path(path).unlink()
    assert ids(spark, uri) == list(range(10)) and records.orphans(uri, older=-60) == []


def test_a_task_that_fails_once_writes_once(tmp_path):
    """On a session that tries tasks again: a task ends after it has written half of its records, and comes a second time."""
    code = f"""
        import os, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        from gradeflow.sources import records
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.dataSource.register(records.Records)
        def once(frames):
            for n, frame in enumerate(frames):
                yield frame.iloc[: len(frame) // 2]
                if (frame.id == 150).any() and not os.path.exists({str(tmp_path / "failed")!r}):
                    open({str(tmp_path / "failed")!r}, "w").close()
                    raise RuntimeError("lost")
                yield frame.iloc[len(frame) // 2 :]
        uri = {str(tmp_path / "log")!r}
        spark.range(0, 400, 1, 4).mapInPandas(once, "id long").write.format("records").mode("append").save(uri)
        print("GOT", sorted(r.id for r in records.read(spark, uri, spark.range(0).schema).collect()) == list(range(400)), len(records.orphans(uri, older=-60)))
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=180, env=os.environ | {"PYSPARK_PYTHON": sys.executable})
    assert (tmp_path / "failed").exists() and "GOT True" in out.stdout, out.stderr[-2000:]


def test_a_replayed_batch_adds_nothing(spark, log_source, tmp_path):
    uri, source = str(tmp_path / "log"), tmp_path / "in"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(source))
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))

    def run():
        rows.writeStream.format("records").option("path", uri).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert ids(spark, uri) == list(range(30)) and len(records.commits(uri)) == 3
    (tmp_path / "state" / "commits" / "2").unlink()  # as after a crash between the log's commit and Spark's
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    spark.range(30, 33).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert ids(spark, uri) == list(range(33)) and len(records.commits(uri)) == 4
    second = rows.writeStream.format("records").option("path", uri).option("writer", "other").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    second.awaitTermination()
    assert len(ids(spark, uri)) == 66


def fed(spark, folder, frames, schema, stream, mode="update"):
    """What a stream gives for each of some batches, started anew for every one, from one checkpoint."""
    out = []
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = []
        query = stream(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.foreachBatch(lambda f, n, got=got: got.extend(map(tuple, f.collect()))).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        out.append((sorted(got, key=repr), query))
    return out


def test_latest_records_across_restarts(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], [("a", 2, "late"), ("b", 2, "again"), ("c", 1, "z")], [("a", 9, "w")]]
    with state.rocksdb(spark):
        got = fed(spark, tmp_path, batches, "k string, seq long, v string", lambda s: state.latest(s, "k"))
    assert [g for g, _ in got] == [[("a", 3, None), ("b", 2, "y")], [("c", 1, "z")], [("a", 9, "w")]]
    held = [op for op in got[-1][1].recentProgress[-1].stateOperators]
    assert held and held[0].numRowsTotal >= 1 and held[0].memoryUsedBytes > 0


def test_breaker_across_restarts_is_that_of_the_batch(spark, tmp_path):
    rows = [("m", i, i % 17 not in (3, 4)) for i in range(60)] + [("n", i, False) for i in range(5)]
    batches = [rows[:20], rows[15:40], rows[40:]]  # some records come twice
    with state.rocksdb(spark):
        got = fed(spark, tmp_path, batches, "k string, seq long, is_error boolean", lambda s: state.breaker(s, "k", 10))
    best = streak = 0
    for _, _, bad in rows[:60]:
        streak = streak + 1 if bad else 0
        best = max(best, streak)
    assert ("m", streak, best, True) in got[-1][0] and ("n", 0, 0, False) in got[-1][0]


def test_token_loops_keep_a_tail(spark, tmp_path):
    stops = lambda tokens: len(tokens) >= 8 and len(set(tokens[-8:])) == 1
    batches = [[("a", 0, [1, 2, 3]), ("b", 0, [5] * 5)], [("b", 0, [5] * 5), ("b", 1, [5] * 2), ("a", 1, list(range(100)))], [("a", 2, [7] * 4), ("b", 2, [5, 5, 5])], [("a", 3, [7] * 4), ("b", 3, [6])]]
    with state.rocksdb(spark):
        got = fed(spark, tmp_path, batches, "k string, seq long, tokens array<long>", lambda s: state.token_loops(s, "k", stops, 8))
    assert [g for g, _ in got] == [[("a", 3, False), ("b", 5, False)], [("a", 103, False), ("b", 7, False)], [("a", 107, False), ("b", 10, True)], [("a", 111, True), ("b", 10, True)]]


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_sessions_and_late_rows(spark, tmp_path):
    batches = [[("u", at(0), False), ("u", at(20), True), ("u", at(100), False), ("v", at(400), False)], [("u", at(110), True), ("u", at(350), False), ("v", at(420), False)], [("w", at(2000), False)]]
    stream = lambda s: progress.sessions(s, "30 minutes", "1 hour", "u")
    got = fed(spark, tmp_path, batches, "u string, ts timestamp, is_error boolean", stream, "append")
    closed = [(r[0], (r[1] - at(0)).total_seconds() / 60, (r[2] - at(0)).total_seconds() / 60, *r[3:]) for g, _ in got for r in g]
    # the first batch moves the watermark to minute 340; the row of minute 110 is late then, that of 350 is not
    assert sorted(closed) == [("u", 0, 50, 2, 1), ("u", 100, 130, 1, 0), ("u", 350, 380, 1, 0), ("v", 400, 450, 2, 0)]
    assert [progress.dropped_late(q) for _, q in got] == [0, 1, 0]


def test_sliding_windows(spark, tmp_path):
    batches = [[("k", at(0)), ("k", at(70)), ("k", at(130))], [("k", at(10_000))]]
    got = fed(spark, tmp_path, batches, "event_type string, ts timestamp", lambda s: progress.windowed_counts(s, "2 hours", "10 minutes", "1 hour"), "append")
    closed = {((r[0] - at(0)).total_seconds() / 60, r[3]) for g, _ in got for r in g}
    assert closed == {(-60, 1), (0, 2), (60, 2), (120, 1)}


def test_commits_are_whole_or_absent(tmp_path):
    (tmp_path / "commits" / "batch").mkdir(parents=True)
    (tmp_path / "commits" / "batch" / "1.json").write_text(json.dumps({"time": 1, "overwrite": False, "files": ["a"], "records": 1}))
    (tmp_path / "commits" / "batch" / "2.json.x.tmp").write_text('{"time": 2')
    assert [c["files"] for c in records.commits(str(tmp_path))] == [["a"]]
