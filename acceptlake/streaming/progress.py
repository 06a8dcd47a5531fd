"""Event log operators, in batch and on streams: pairing, progress, counts, deduplication, scanning, gates, sessions.

events: run_id, event_id, stage, status, ts. Streams read a folder of event files and end when all that is there is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as X
from ..operators import policy as P
from ..sources.staging import shared_folder


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there, each batch through write, with its state in the shared folder and, on the executors, in RocksDB."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def into_table(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The stream's result as a table: each batch's rows are appended, or, with keys, the last row written of each key counts (update mode).
    A batch that is written again replaces itself."""
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession, "sink")
    drained(stream, "update" if keys else "append", lambda df, n: df.write.mode("overwrite").parquet(f"{root}/batch={n}"))
    rows = spark.read.option("basePath", root).schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/batch=*")
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")
    return rows.select(stream.columns)


def stage_event_pairing(events: DataFrame) -> DataFrame:
    """Each finish event with the latest start of the same run and stage before it: duration in ms (null without a start) and final status."""
    order = Window.partitionBy("run_id", "stage").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("started_at", F.last(F.when(F.col("status") == "running", F.col("ts")), ignorenulls=True).over(order))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.where(F.col("status").isin("completed", "failed")).select("run_id", "stage", "event_id", "status", F.floor((us("ts") - us("started_at")) / 1000).alias("duration_ms"))


def _frames(rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=names)


class _Pairing(StatefulProcessor):
    """Events of one run and stage wait until the watermark has passed them, and are then paired in the order of their times."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "us long")
        self.waiting = handle.getListState("waiting", "us long, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(part["us"].tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self._wake([r[0] for r in new])  # what waits already has its own timer
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 < passed]
        rest = rows[len(due) :]
        before = start = self.start.get()[0] if self.start.exists() else None
        out = []
        for us, event_id, status in due:
            if status in ("completed", "failed"):
                ms = None if start is None else (us - start) // 1000
                out.append((*key, event_id, status, ms if ms is None or ms <= self.keep_ms else None))
            elif status == "running":
                start = us
        if start is not None and not rest and start // 1000 + self.keep_ms <= passed:
            start = None
        if due:  # of several timers that are due the first finds all rows
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if start is None and before is not None:
            self.start.clear()
        elif start != before:
            self.start.update((start,))
        if rest:
            self._wake([r[0] for r in rest])
        elif start is not None:
            self.handle.registerTimer(max(start // 1000, passed) + self.keep_ms)
        return _frames(out, ["run_id", "stage", "event_id", "status", "duration_ms"])

    def _wake(self, times: list[int]) -> None:
        self.handle.registerTimer(min(times) // 1000 + 1)

    def close(self) -> None:
        pass


def stage_event_stream(events: DataFrame, late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """stage_event_pairing on a stream, by event time: events of a run and stage are held until the watermark has passed them, so a start that
    comes in a later batch than its finish pairs with it. A start is forgotten `keep` after it: later finishes have none, and it leaves the state when
    the watermark has come so far. Events later than the watermark are dropped."""
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    run = events.schema["run_id"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("run_id", "stage", F.col("event_id").cast("long").alias("event_id"), "status", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("run_id", "stage").transformWithStateInPandas(_Pairing(ms), f"run_id {run}, stage string, event_id long, status string, duration_ms long", "Append", "EventTime")


def run_progress(events: DataFrame) -> DataFrame:
    """Latest stage and status of each run, and how many events it has had."""
    last = F.max_by(F.struct("stage", "status"), F.struct("ts", "event_id"))
    return events.groupBy("run_id").agg(last.alias("last"), F.count("*").alias("events")).select("run_id", "last.stage", "last.status", "events")


class _Progress(StatefulProcessor):
    """The latest event of a run and how many there were; gone when the watermark has passed the latest by `keep`."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, event_id long, stage string, status string, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best, n = (tuple(held)[:4], held[4]) if held is not None else (None, 0)
        for part in rows:
            n += len(part)
            top = max(zip(part["us"].tolist(), part["event_id"].tolist(), part["stage"].tolist(), part["status"].tolist(), strict=True))
            best = top if best is None else max(best, top)
        self.last.update((*best, n))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(best[0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        return _frames([(*key, best[2], best[3], n)], ["run_id", "stage", "status", "events"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_progress_stream(events: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """run_progress on a stream, for update mode: a row for each run that a batch has events of. A run that is silent for `keep` leaves the
    state; should it speak again, it counts anew. Events later than the watermark are dropped."""
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    run = events.schema["run_id"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("run_id", F.col("event_id").cast("long").alias("event_id"), "stage", "status", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Progress(ms), f"run_id {run}, stage string, status string, events long", "Update", "EventTime")


def finding_counts(findings: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Findings of each severity in each window of ts. On a stream, rows later than the watermark are dropped."""
    rows = findings.withWatermark("ts", late) if findings.isStreaming else findings
    return rows.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "severity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


def dedupe_within(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first finding of each fingerprint within the watermark."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def scan_texts(files: DataFrame) -> DataFrame:
    """Whether a text holds a readable credential, and its redacted form; no state."""
    return files.select("path", X.leaks(F.col("text")).alias("leaks"), X.redact_text(F.col("text")).alias("text"))


def policy_gate(metrics: DataFrame, rules: DataFrame, root: str) -> None:
    """Decisions and verdicts for each batch of a stream of metrics, written under root."""

    def write(batch: DataFrame, n: int) -> None:
        P.policy_verdict(P.policy_decisions(batch, rules)).write.mode("overwrite").parquet(f"{root}/batch={n}")

    drained(metrics, "append", write)


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a run that follow each other within the gap: start, end (the last event plus the gap) and number. On a stream a session is given
    when the watermark has passed its end (append mode) and then leaves the state; events later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
