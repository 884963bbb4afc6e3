"""The ledger as a stream: a keyed state machine, live counts, and event-time windows over the events table.

The state machine and the counts are the batch operators' live forms; the event-time windows are an addition for the events table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from parley.operators.workflow import Record
from parley.sources.snapshots import Snapshots

STEPS = "bvid long, part int, ord long, event string, before string, after string, accepted boolean, first boolean"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    record = Record()
    begins = not state.exists
    if state.exists:
        record.state, record.failed_from = state.get
    rows = []
    for r in pd.concat(list(frames)).sort_values("ord").itertuples():
        before = record.state
        ok = record.take(r.event, r.verdict)
        rows.append((key[0], key[1], r.ord, r.event, before, record.state, ok, begins))
        begins = False
    state.update((record.state, record.failed_from))
    yield pd.DataFrame(rows, columns=["bvid", "part", "ord", "event", "before", "after", "accepted", "first"])


def ledger_stream(events: DataFrame) -> DataFrame:
    """Each event (bvid, part, ord, event, verdict) of a stream with the state before and after, and whether it is the item's first; events without an edge are rejected and change nothing."""
    return events.groupBy("bvid", "part").applyInPandasWithState(_advance, STEPS, "state string, failed_from string", "append", GroupStateTimeout.NoTimeout)


def accepted_counts(events: DataFrame) -> DataFrame:
    """Live number of events of each kind, for output mode complete."""
    return events.groupBy("event").count()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Number and sum of value of each type in tumbling or sliding windows of ``ts``, with a watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events that follow each other within ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_tasks(tasks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tasks (bvid, part, stage, ts) of a stream without their repeats within ``late``; ``running_tasks`` refuses them until the task has ended."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["bvid", "part", "stage"])


TASKS = "bvid long, part int, stage string, ts timestamp, kind string, accepted boolean"


class _Tasks(StatefulProcessor):
    """One task of an item and stage at a time: a start is refused while one runs, that is until its end or its time-out."""

    def __init__(self, longest_ms: int):
        self.longest = longest_ms

    def init(self, handle) -> None:
        self.handle, self.since = handle, handle.getValueState("since", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        since = self.since.get()[0] if self.since.exists() else None
        begun, found = since, []
        for r in pd.concat(list(rows)).sort_values(["ts", "kind"]).itertuples():
            now = int(r.ts.timestamp() * 1000)
            running = since is not None and now < since + self.longest
            ok = running if r.kind == "end" else not running
            if ok:
                since = None if r.kind == "end" else now
            found.append((*key, r.ts, r.kind, ok))
        if since != begun:
            if begun is not None:
                self.handle.deleteTimer(begun + self.longest)
            if since is None:
                self.since.clear()
            else:
                self.since.update((since,))
                self.handle.registerTimer(since + self.longest)
        yield pd.DataFrame(found, columns=["bvid", "part", "stage", "ts", "kind", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.since.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(*key, at, "timeout", True)], columns=["bvid", "part", "stage", "ts", "kind", "accepted"])

    def close(self) -> None:
        pass


def running_tasks(tasks: DataFrame, longest: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Starts and ends (bvid, part, stage, ts, kind: start or end) of a stream, each accepted or refused, and a row for each task that timed out.

    A start is refused while a task of the item and stage runs, until its end event or ``longest`` after its start; an end without
    a running task is refused. Timers follow event time with the watermark ``late``. Needs the RocksDB state store.
    """
    ms = int(pd.Timedelta(longest).total_seconds() * 1000)
    keyed = tasks.withWatermark("ts", late).groupBy("bvid", "part", "stage")
    return keyed.transformWithStateInPandas(_Tasks(ms), TASKS, "append", "EventTime")


def state_counts(steps: DataFrame) -> DataFrame:
    """Items now in each state, from steps of ``ledger_stream``: what went in less what went out. Of a table or, in output mode complete, of a stream."""
    moved = F.array(F.struct(F.col("after").alias("state"), F.lit(1).alias("n")), F.struct(F.col("before").alias("state"), F.when(F.col("first"), 0).otherwise(-1).alias("n")))
    return steps.select(F.inline(moved)).groupBy("state").agg(F.sum("n").alias("items")).filter("items <> 0")


def write_steps(events: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Run ``ledger_stream`` into snapshots of a table, each batch whole and once: a batch that is run again is in already. Returns the query.

    The table has one writer at a time: what another puts between is kept, and the batch is put after it.
    """

    def put(batch: DataFrame, number: int) -> None:
        Snapshots(batch.sparkSession, path).append(batch, checkpoint, number)

    writer = ledger_stream(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def steps_to_files(events: DataFrame, path: str, checkpoint: str):
    """Writer of ``ledger_stream`` to a folder of files whose log tells each batch once, so that ``live_counts`` can follow it."""
    return ledger_stream(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """Items in each state as a stream over the files of ``steps_to_files``, for output mode complete."""
    return state_counts(spark.readStream.schema(STEPS).parquet(path))
