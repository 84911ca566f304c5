"""Streams that arrive in several batches, one file each."""

import pytest

from lectern.operators.model import apply_model
from lectern.streaming import ledger as live

EVENTS = "path string, ts timestamp, seq long, status string, error string"


def batches(spark, folder, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(stream, folder, mode):
    stream.writeStream.foreachBatch(live.batch_folders(f"{folder}/out")).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def event(path, second, status, error=None):
    import datetime

    return path, datetime.datetime(2024, 1, 1, 0, 0, second), second, status, error


def test_new_files_once(spark, tmp_path):
    stream = batches(spark, tmp_path, "path string", [("a.mp3",), ("a.mp3",), (None,)], [("b.TXT",), ("a.mp3",)])
    got = spark.read.parquet(run(live.stream_new_files(stream), tmp_path, "append")).collect()
    assert sorted((r.path, r.status, r.mode) for r in got) == [("a.mp3", "pending", "transcribe"), ("b.TXT", "pending", "text")]


def test_ledger_and_counts_over_batches(spark, tmp_path):
    parts = [[event("a", 1, "pending"), event("b", 1, "pending")], [event("a", 5, "done"), event("b", 2, "in_progress")], [event("a", 3, "in_progress"), event("b", 4, "failed", "E1")]]
    (tmp_path / "l").mkdir(), (tmp_path / "c").mkdir()
    rows = run(live.stream_ledger(batches(spark, tmp_path / "l", EVENTS, *parts)), tmp_path / "l", "update")
    assert sorted((r.path, r.status, r.error) for r in live.read_ledger(spark, rows).collect()) == [("a", "done", None), ("b", "failed", "E1")]
    rows = run(live.stream_status_changes(batches(spark, tmp_path / "c", EVENTS, *parts)), tmp_path / "c", "append")
    assert sorted(map(tuple, live.read_counts(spark, rows).collect())) == [("done", 1), ("failed", 1)]


@pytest.mark.parametrize("reset, stops", [(False, [("j", "E1", 4)]), (True, [])])
def test_breaker_over_batches(spark, tmp_path, reset, stops):
    parts = [[event("j", 1, "failed", "E1"), event("j", 2, "failed", "E1"), event("k", 1, "failed", None)], [event("j", 4, "failed", "E1"), event("j", 3, "done")], [event("j", 5, "failed", "E1"), event("k", 2, "failed", "E2")]]
    stream = live.stream_breaker(batches(spark, tmp_path, EVENTS, *parts), reset_on_success=reset)
    got = spark.read.parquet(run(stream, tmp_path, "append")).collect()
    assert [(r.path, r.error, r.seq) for r in got] == stops


def test_progress_over_batches(spark, tmp_path):
    schema = "path string, seg_id long, end double, duration double, text string"
    stream = batches(spark, tmp_path, schema, [("a", 1, 4.0, 10.0, "three four"), ("a", 0, 2.0, 10.0, "one  two")], [("a", 2, 12.0, 10.0, "five"), ("b", 0, 1.0, None, None)])
    got = spark.read.parquet(run(live.stream_progress(stream, n=3), tmp_path, "update")).collect()
    assert sorted((r.path, r.fraction, r.excerpt, r.batch) for r in got) == [("a", 0.4, "two three four", 0), ("a", 1.0, "three four five", 1), ("b", None, "", 1)]


def test_model_hook(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r.result for r in apply_model(df, lambda texts: [t.upper() + "!" for t in texts], batch=2).collect()}
    assert got == {1: "B!", 2: "A!", 3: "B!", 4: None, 5: "!"}
    with pytest.raises(Exception, match="gave 0 results"):
        apply_model(df, lambda texts: []).collect()
