"""A resumable work queue: what is selected and not done yet is worked on in micro-batches, each recorded in a ledger.

The ledger is append-only and its latest entry per key counts, so a batch that runs again after a failure only repeats
entries. Failed keys stay pending, and every start works on them again beside what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

DONE = ("done", "rejected")


def latest(ledger: DataFrame, key: str, order: str = "at") -> DataFrame:
    return ledger.groupBy(key).agg(F.max_by("status", F.struct(F.col(order), "status")).alias("status"), F.count(F.lit(1)).alias("tries"))


def pending(selected: DataFrame, ledger: DataFrame, key: str, order: str = "at") -> DataFrame:
    """Selected rows whose latest entry is not final."""
    final = latest(ledger, key, order).where(F.col("status").isin(*DONE)).select(key)
    return selected.join(final, key, "left_anti")


def start(spark: SparkSession, source: str, schema: StructType, key: str, work: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Follow the Parquet folder ``source``; ``work`` gives (key, status) for the rows that are still pending."""
    retried: list[int] = []
    entries = StructType().add(schema[key]).add("status", "string").add("at", "long")

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        try:
            known = session.read.schema(entries).parquet(ledger)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = session.createDataFrame([], entries)
        if number not in retried:  # the first batch of this start
            retried.append(number)
            failed = latest(known, key).where(~F.col("status").isin(*DONE)).select(key) if len(retried) == 1 else None
            if failed is not None:
                rows = rows.unionByName(session.read.schema(schema).parquet(source).join(failed, key, "left_semi"))
        todo = pending(rows.dropDuplicates([key]), known, key)
        work(todo).select(key, "status", F.lit(number).cast("long").alias("at")).write.mode("append").parquet(ledger)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
