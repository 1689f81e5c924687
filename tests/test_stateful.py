"""The stateful queue: retries without a restart, reuse, giving up, and a restart in the middle."""

import time

from pyspark.sql import functions as F

from gridloom.streaming import stateful as Q


def until(spark, query, log, done, seconds=150):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        try:
            rows = [tuple(r) for r in spark.read.parquet(log).select("key", "action", "attempt").distinct().collect()]
        except Exception:  # nothing written yet
            rows = []
        if done(rows):
            return rows
        time.sleep(1)
    raise AssertionError(rows)


def work(todo):
    """``flaky`` keys succeed at the second try, ``bad`` ones never."""
    event = F.when(F.col("key").startswith("bad"), "failed").when(F.col("key").startswith("flaky") & (F.col("attempt") < 2), "failed").when(F.col("key").startswith("no"), "rejected").otherwise("done")
    return todo.select("key", event.alias("event"))


def test_queue(spark, tmp_path):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("events", "log", "checkpoint"))
    keys = ["a", "b", "flaky1", "flaky2", "bad", "no"]
    Q.ask(spark.createDataFrame([(k,) for k in keys], "key string"), folder)
    begin = lambda: Q.start(spark, folder, work, log, checkpoint, tries=3, pause_ms=300, every="500 milliseconds")
    query = begin()
    try:
        rows = until(spark, query, log, lambda rows: ("bad", "gave_up", 3) in rows and ("flaky2", "work", 2) in rows)
        assert {(k, t) for k, a, t in rows if a == "work"} == {(k, 1) for k in keys} | {("flaky1", 2), ("flaky2", 2), ("bad", 2), ("bad", 3)}
    finally:
        query.stop()
    Q.ask(spark.createDataFrame([("a",), ("no",), ("flaky1",), ("c",)], "key string"), folder, at=9)
    query = begin()  # goes on where it stopped: what is done is not done again
    try:
        rows = until(spark, query, log, lambda rows: ("c", "work", 1) in rows and len([r for r in rows if r[1] == "reused"]) == 3)
    finally:
        query.stop()
    assert {k for k, a, _ in rows if a == "reused"} == {"a", "no", "flaky1"}
    assert tuple(Q.counts(spark.read.parquet(log)).first()) == (7, 3, 3, 1)
