from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.sources import files
from docloom.streaming import runs


def test_raw_texts_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    files.write_raw_texts(spark.createDataFrame([("d", "r", "täxt")], "document_id string, run_id string, text string"), path)
    asked = spark.createDataFrame([("d", "r"), ("d", "q")], "document_id string, run_id string")
    assert {(r.run_id, r.text) for r in files.read_raw_texts(spark, path, asked).collect()} == {("r", "täxt"), ("q", None)}


def test_snapshots_keep_the_last(spark, tmp_path):
    old = spark.createDataFrame([("d", f"r{i:02}", i, "old") for i in range(25)], "document_id string, run_id string, created_at int, v string")
    new = spark.createDataFrame([("d", "r24", 99, "new")], old.schema)
    kept = files.keep_snapshots(old, new)
    assert kept.count() == 20 and kept.filter("run_id = 'r24'").first().v == "new" and kept.filter("run_id = 'r04'").count() == 0
    (tmp_path / "s.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_snapshots(spark, str(tmp_path / "s.json"), "a int").collect()) == [1, 2]


def test_uploads(spark):
    df = spark.createDataFrame([("application/pdf", "a.PDF", 5), ("text/html", "a.pdf", 5), ("application/pdf", "a.pdf", 0), ("application/pdf", "a.pdf", 30_000_000)], "content_type string, original_filename string, file_size long")
    good, bad = files.split_uploads(df)
    assert good.count() == 1 and {r.error for r in bad.collect()} == {"UNSUPPORTED_MEDIA_TYPE", "EMPTY_FILE", "FILE_TOO_LARGE"}


def test_active_artifacts(spark):
    df = spark.createDataFrame([("a1", "r", "T", "x", 1), ("a2", "r", "T", "y", 1), ("a3", "r", "U", "z", 0)], "artifact_id string, run_id string, artifact_type string, payload string, created_at int")
    assert {r.artifact_id for r in files.active_artifacts(df).collect()} == {"a2", "a3"}


def test_run_states_as_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    events = [("d", "r1", "RUNNING", t), ("d", "r2", "RUNNING", t + timedelta(seconds=5)), ("d", "r1", "COMPLETED", t + timedelta(seconds=9)), ("d", "r3", "RUNNING", t + timedelta(seconds=20)), ("d", "r4", "RUNNING", t + timedelta(seconds=400)), ("e", "r5", "COMPLETED", t)]
    src = str(tmp_path / "in")
    spark.createDataFrame(events, "document_id string, run_id string, state string, at timestamp").coalesce(1).write.parquet(src)
    stream = runs.state_changes(spark.readStream.schema("document_id string, run_id string, state string, at timestamp").parquet(src))
    runs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [(r.run_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "run_id").collect()]
    assert got[:5] == [("r1", "RUNNING"), ("r1", "COMPLETED"), ("r3", "RUNNING"), ("r3", "TIMED_OUT"), ("r4", "RUNNING")]


def test_window_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    t = datetime(2024, 1, 1, 12)
    spark.createDataFrame([(t, "a"), (t + timedelta(minutes=5), "a"), (t + timedelta(hours=30), "b")], "ts timestamp, event_type string").write.parquet(src)
    runs.run_once(runs.counts_by_window(spark.readStream.schema("ts timestamp, event_type string").parquet(src)), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.event_type, r["count"]) for r in spark.read.parquet(str(tmp_path / "o")).filter(F.col("event_type") == "a").collect()] == [("a", 2)]
