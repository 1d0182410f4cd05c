import json
import time

from lexmill.streaming import jobs


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("job_id", "status", "ts"), r))) for r in rows))


ROWS = [("a", "QUEUED", "2024-01-01T00:00:00"), ("a", "QUEUED", "2024-01-01T00:01:00"), ("a", "FAILED", "2024-01-01T00:02:00"), ("a", "QUEUED", "2024-01-01T00:03:00"), ("b", "QUEUED", "2024-01-01T02:00:00"), ("b", "COMPLETED", "2024-01-01T02:10:00")]


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_latest_equals_batch(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS)
    got = _run(jobs.latest_status(jobs.read_events(spark, str(tmp_path / "in"))), "latest", "complete")
    batch = jobs.latest_status(spark.read.schema(jobs.JOB_EVENT).json(str(tmp_path / "in"))).collect()
    assert sorted(got) == sorted(batch) and {r.job_id: r.status for r in got} == {"a": "QUEUED", "b": "COMPLETED"}


def test_duplicate_starts(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS)
    got = _run(jobs.reject_duplicate_starts(jobs.read_events(spark, str(tmp_path / "in"))), "starts", "append")
    verdicts = [r.verdict for r in sorted(got, key=lambda r: (r.job_id, r.ts))]
    assert verdicts == ["accepted", "duplicate", "step", "accepted", "accepted", "step"]


def test_windows_and_document_status(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS)
    batch = spark.read.schema(jobs.JOB_EVENT).json(str(tmp_path / "in"))
    hours = {(r.window_start.hour, r.status): r.n for r in jobs.status_windows(batch).collect()}
    assert hours[0, "QUEUED"] == 3 and hours[2, "COMPLETED"] == 1
    assert {r.document_status for r in jobs.with_document_status(batch).collect()} == {"QUEUED", "FAILED_INDEXING", "READY"}
    assert sorted(r.n for r in jobs.upload_sessions(batch).collect()) == [2, 4]


def test_latest_with_expiry(spark, tmp_path):
    """Processing-time state never lets availableNow end, so the query runs for a bounded time and is stopped."""
    _write(tmp_path / "in", "a.json", ROWS)
    df = jobs.latest_status_with_expiry(jobs.read_events(spark, str(tmp_path / "in")))
    q = df.writeStream.format("memory").queryName("expiry").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    deadline = time.time() + 60
    try:
        while time.time() < deadline and spark.table("expiry").count() < 2:
            time.sleep(1)
    finally:
        q.stop()
    assert {r.job_id: r.status for r in spark.table("expiry").collect()} == {"a": "QUEUED", "b": "COMPLETED"}


def test_status_expires(spark, tmp_path):
    """An event older than the last one counts again once the state is gone."""
    source = tmp_path / "in"
    _write(source, "1.json", [("a", "INDEXING", "2024-01-01T05:00:00")])
    df = jobs.latest_status_with_expiry(jobs.read_events(spark, str(source)), ttl_ms=3000)
    q = df.writeStream.format("memory").queryName("expires").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()

    def seen(n):
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("expires").count() < n:
            time.sleep(0.5)
        return [r.status for r in spark.table("expires").collect()]

    try:
        assert seen(1) == ["INDEXING"]
        time.sleep(6)
        _write(source, "2.json", [("a", "QUEUED", "2024-01-01T01:00:00")])
        assert seen(2) == ["INDEXING", "QUEUED"]
    finally:
        q.stop()


def test_stalled_jobs(spark, tmp_path):
    """Jobs without an end are reported once the watermark has passed their idle time."""
    source, found = tmp_path / "in", []
    for k, rows in enumerate([[("a", "QUEUED", "2024-01-01T00:00:00"), ("b", "COMPLETED", "2024-01-01T00:00:00"), ("d", "QUEUED", "2024-01-01T00:00:00")], [("d", "COMPLETED", "2024-01-01T00:05:00"), ("c", "QUEUED", "2024-01-01T03:00:00")], [("c", "FAILED", "2024-01-01T03:01:00")]]):
        _write(source, f"{k}.json", rows)
        df = jobs.stalled_jobs(jobs.read_events(spark, str(source)))
        q = df.writeStream.foreachBatch(lambda d, _: found.extend(d.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert [(r.job_id, r.status) for r in found] == [("a", "QUEUED")]


def test_sliding_windows(spark, tmp_path):
    _write(tmp_path / "in", "a.json", ROWS)
    batch = spark.read.schema(jobs.JOB_EVENT).json(str(tmp_path / "in"))
    got = {(r.window_start.strftime("%H:%M"), r.status): r.n for r in jobs.status_windows(batch, "1 hour", "30 minutes").collect()}
    assert got["23:30", "QUEUED"] == got["00:00", "QUEUED"] == 3 and ("00:30", "QUEUED") not in got and got["01:30", "COMPLETED"] == got["02:00", "COMPLETED"] == 1
