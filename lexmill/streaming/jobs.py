"""Streams of ingestion job events: latest status with expiry, duplicate starts, stalled jobs, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from lexmill.functions.scalars import document_status

#: A job's last status is kept this long (fixed value).
STATUS_TTL_MS = 86_400_000
TERMINAL = ("READY", "COMPLETED", "FAILED")

JOB_EVENT = StructType([
    StructField("job_id", StringType()), StructField("document_id", StringType()), StructField("status", StringType()), StructField("progress", StringType()),
    StructField("current_step", StringType()), StructField("error_message", StringType()), StructField("ts", TimestampType()),
])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Job events from a folder of JSON lines; other sources only need the same columns."""
    return spark.readStream.schema(JOB_EVENT).json(path)


def with_document_status(events: DataFrame) -> DataFrame:
    """The document status that each job status stands for; stateless."""
    return events.withColumn("document_status", document_status(F.col("status")))


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of every job by event time, for update or complete mode; the batch form is the same plan."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "ts"), "ts").alias("e")).select("job_id", "e.*")


class _Latest(StatefulProcessor):
    """Keeps the last status of a job and forgets it after its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, ts timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        for batch in rows:
            for status, ts in zip(batch["status"], batch["ts"]):
                if best is None or ts >= best[1]:
                    best = (status, ts)
        self.last.update(best)
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[0]], "ts": [best[1]]})

    def close(self) -> None:
        pass


def latest_status_with_expiry(events: DataFrame, ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """As ``latest_status``, with state that expires a day after its last write; needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(_Latest(ttl_ms), outputStructType="job_id string, status string, ts timestamp", outputMode="update", timeMode="processingTime")


class _Starts(StatefulProcessor):
    """Accepts a start only if the job is not running; terminal events end the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        on = bool(self.running.get()[0]) if self.running.exists() else False
        # A job's events of one micro-batch may come in several Arrow batches; they are judged in the order of their times.
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        verdicts = []
        for status in batch["status"]:
            start = status == "QUEUED"
            verdicts.append("duplicate" if start and on else "accepted" if start else "step")
            on = (on or start) and status not in TERMINAL
        yield pd.DataFrame({"job_id": key[0], "status": batch["status"], "ts": batch["ts"], "verdict": verdicts})
        self.running.update((on,))

    def close(self) -> None:
        pass


def reject_duplicate_starts(events: DataFrame) -> DataFrame:
    """Each event with the verdict accepted, duplicate or step."""
    return events.groupBy("job_id").transformWithStateInPandas(_Starts(), outputStructType="job_id string, status string, ts timestamp, verdict string", outputMode="append", timeMode="none")


class _Stalled(StatefulProcessor):
    """Reports a job that has sent nothing for ``idle_ms`` of event time and has not ended."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        for batch in rows:
            for status, ts in zip(batch["status"], batch["ts"]):
                at = int(ts.timestamp() * 1000)
                if best is None or at >= best[1]:
                    best = (status, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[0] not in TERMINAL:
            self.handle.registerTimer(best[1] + self.idle_ms)
        self.last.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"job_id": [key[0]], "status": [self.last.get()[0]]})

    def close(self) -> None:
        pass


def stalled_jobs(events: DataFrame, idle_ms: int = 600_000, lateness: str = "1 minute") -> DataFrame:
    """(job_id, last status) of jobs idle for ``idle_ms`` of event time."""
    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("job_id").transformWithStateInPandas(_Stalled(idle_ms), outputStructType="job_id string, status string", outputMode="append", timeMode="eventTime")


def status_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events per window and status; tumbling, or sliding with ``slide``."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.withWatermark("ts", lateness).groupBy(win.alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n")


def upload_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each job's events, split at gaps."""
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.count("*").alias("n"))
    return s.select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def publish(events: DataFrame, write_batch, checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``write_batch(df, batch_id)`` and stop when the input is used up."""
    return events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
