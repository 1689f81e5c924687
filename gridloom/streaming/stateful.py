"""The work queue as keyed state: what is asked for, what is known of it, and when it is tried again.

Events (key, event, at) arrive as Parquet files in a folder: ``asked`` for a leaf, and ``done``, ``rejected`` or ``failed`` as reports of
work. State per key holds its status, the tries so far and what is due; no batch reads the ledger as a whole. The state
answers with actions: ``work`` (try number n), ``reused`` (asked for again although it is done), ``gave_up`` (failed ``tries`` times). A
failed key sets a timer and is due again after a pause that doubles with each try, without a restart.

``start`` runs the work of a batch's actions and appends its reports to the same folder, where the stream finds them as its
next input. A batch that is repeated after a crash appends its reports again, which changes nothing: a report counts only
for the try that is under way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "key string, event string, attempt int, at long"
ACTIONS = "key string, action string, attempt int"
FINAL = ("done", "rejected")


class Leaf(StatefulProcessor):
    """One key's state: status (new, working, waiting, done, rejected, gave_up) and try."""

    def __init__(self, tries: int, pause_ms: int):
        self._tries, self._pause = tries, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("leaf", "status string, attempt int")

    def _now(self) -> tuple[str, int]:
        return tuple(self._state.get()) if self._state.exists() else ("new", 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "attempt", "event"])
        status, tried = self._now()
        out = []
        for event, of in zip(events["event"], events["attempt"]):
            if event == "asked":
                if status == "new":
                    status, tried = "working", 1
                    out.append(("work", tried))
                elif status in FINAL:
                    out.append(("reused", tried))
            elif status == "working" and of == tried:
                if event in FINAL:
                    status = event
                elif tried < self._tries:
                    status = "waiting"
                    self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._pause * 2 ** (tried - 1))
                else:
                    status = "gave_up"
                    out.append(("gave_up", tried))
        self._state.update((status, int(tried)))
        yield self._shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, tried = self._now()
        if status == "waiting":
            self._state.update(("working", int(tried) + 1))
            yield self._shown(key, [("work", tried + 1)])
        else:
            yield self._shown(key, [])

    def close(self) -> None:
        pass

    @staticmethod
    def _shown(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "action": pd.Series([a for a, _ in out], dtype=object), "attempt": pd.Series([t for _, t in out], dtype="int32")})


def actions(events: DataFrame, tries: int = 3, pause_ms: int = 60_000) -> DataFrame:
    """Actions of a stream of events. The session's state store must be RocksDB's."""
    return events.where("key is not null").groupBy("key").transformWithStateInPandas(statefulProcessor=Leaf(tries, pause_ms), outputStructType=ACTIONS, outputMode="Append", timeMode="ProcessingTime")


def ask(keys: DataFrame, folder: str, at: int = 0) -> None:
    """Append a request for each key."""
    keys.select(F.col("key").cast("string"), F.lit("asked").alias("event"), F.lit(0).cast("int").alias("attempt"), F.lit(at).cast("long").alias("at")).write.mode("append").parquet(folder)


def start(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, tries: int = 3, pause_ms: int = 60_000, every: str = "10 seconds", files_per_batch: int = 256) -> StreamingQuery:
    """Follow ``folder``; ``work`` gives (key, event) for the rows (key, attempt) that are to be worked on. Actions are appended to ``log``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()  # read twice, and state answers once
        try:
            held.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(log)
            todo = held.where("action = 'work'").select("key", "attempt")
            if todo.isEmpty():
                return
            reports = work(todo).select("key", "event").join(todo, "key").withColumn("at", F.lit(number).cast("long"))
            reports.select("key", "event", "attempt", "at").write.mode("append").parquet(folder)
        finally:
            held.unpersist()

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return actions(stream, tries, pause_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def counts(log: DataFrame) -> DataFrame:
    """Keys rendered (worked on), retried, reused and given up."""
    of = lambda condition: F.count_distinct(F.when(condition, F.col("key")))
    action, n = F.col("action"), F.col("attempt")
    return log.agg(of((action == "work") & (n == 1)).alias("worked"), of((action == "work") & (n > 1)).alias("retried"), of(action == "reused").alias("reused"), of(action == "gave_up").alias("gave_up"))
