"""The watch service as Structured Streaming: normalize events, wait for silence, coalesce per path, update in batches.

``debounced`` holds a repository's events until nothing has come for a while (each event starts the wait anew), with
state and timers of the stream; ``run`` gives each batch to an update, once: a batch that was applied before the stream
stopped is known by its number and passed over when it comes again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.maintain import coalesced
from ..sources.files import is_source


def normalized(events: DataFrame) -> DataFrame:
    """``events(path, op, ts, seq)``: slashes, source files only, known operations."""
    rows = events.withColumn("path", F.regexp_replace("path", r"\\", "/"))
    return rows.where(is_source(F.col("path")) & F.col("op").isin("add", "change", "unlink"))


def bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Events between pauses, one row for each repository and path: the last operation of the burst."""
    rows = normalized(events).withWatermark("ts", late)
    last = F.max_by(F.when(F.col("op") == "unlink", "delete").otherwise("upsert"), F.struct("ts", "seq"))
    return rows.groupBy("repo", F.session_window("ts", gap).alias("w"), "path").agg(last.alias("op")).select("repo", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "path", "op")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHORTEST_MS, DEFAULT_MS = 50, 500


class Debounce(StatefulProcessor):
    """Of a repository: the last operation of each path, and when its silence ends."""

    def __init__(self, silence_ms: int):
        self.silence_ms = max(silence_ms, SHORTEST_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "op string, at long, seq long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        for r in rows:
            before = self.pending.getValue((r["path"],)) if self.pending.containsKey((r["path"],)) else None
            if before is None or (before[1], before[2]) <= (r["at"], r["seq"]):
                self.pending.updateValue((r["path"],), ("delete" if r["op"] == "unlink" else "upsert", r["at"], r["seq"]))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(at)
        self.due.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # type: ignore[no-untyped-def]  # noqa: N802, N803
        for (path,), (op, at, seq) in self.pending.iterator():
            yield Row(repo=key[0], path=path, op=op, at=at, seq=seq)
        self.pending.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def debounced(events: DataFrame, silence_ms: int = DEFAULT_MS) -> DataFrame:
    """``events(repo, path, op, ts, seq)`` → repo, path, op (upsert or delete), ts, seq of each path's last event, after ``silence_ms`` without
    any event of the repository (50 at least); until then they wait in the stream's state."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = normalized(events).select("repo", "path", "op", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"))
    held = rows.groupBy("repo").transformWithState(statefulProcessor=Debounce(silence_ms), outputStructType="repo string, path string, op string, at long, seq long", outputMode="append", timeMode="processingTime")
    return held.select("repo", "path", "op", F.timestamp_micros("at").alias("ts"), "seq")


def once(spark: SparkSession, folder: str, update: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``update`` that passes over batches that it has finished before: a mark in ``folder`` tells."""
    path = spark._jvm.org.apache.hadoop.fs.Path

    def each(batch: DataFrame, number: int) -> None:
        done = path(f"{folder}/{number}.done")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(done):
            return
        update(batch, number)
        fs.create(done, True).close()
        old = path(f"{folder}/{number - 100}.done")
        if fs.exists(old):
            fs.delete(old, False)

    return each


def flushes(events: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, silence_ms: int = DEFAULT_MS, every: str = "100 milliseconds") -> StreamingQuery:
    """Gives what ``debounced`` lets go to ``update``, each batch once; one that failed is tried again when the stream starts anew."""
    applied = once(events.sparkSession, f"{checkpoint}/applied", lambda batch, number: None if batch.isEmpty() else update(batch, number))
    return debounced(events, silence_ms).writeStream.foreachBatch(applied).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run(events: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Gives each micro-batch's coalesced events to ``update``, once; a failed batch is tried again."""

    def some(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            update(coalesced(batch), number)

    each = once(events.sparkSession, f"{checkpoint}/applied", some)
    writer = normalized(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


class Progress(StreamingQueryListener):
    """What the streams of a session have done, from their own reports: rows and seconds, and how long ``left`` rows take at that pace."""

    def __init__(self) -> None:
        self.rows, self.seconds, self.failed = 0, 0.0, 0

    def onQueryStarted(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        if event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.seconds += event.progress.durationMs.get("triggerExecution", 0) / 1000

    def onQueryTerminated(self, event) -> None:  # type: ignore[no-untyped-def]  # noqa: N802
        self.failed += event.exception is not None

    def left(self, rows: int) -> float | None:
        """Seconds that ``rows`` more take; None before anything was done."""
        return rows * self.seconds / self.rows if self.rows else None


def drain(query: StreamingQuery, settle_seconds: float = 0.2) -> None:
    """Waits until all that has arrived is processed, and once more for what arrives while it settles; then stops."""
    import time

    query.processAllAvailable()
    time.sleep(settle_seconds)
    query.processAllAvailable()
    query.stop()


def pending(events: DataFrame) -> DataFrame:
    """How many paths wait for an update and how many for a deletion."""
    op = coalesced(normalized(events))
    return op.agg(F.count_if(F.col("op") == "upsert").alias("changes"), F.count_if(F.col("op") == "delete").alias("deletes"))
