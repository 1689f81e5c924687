"""Helpers that every corpus operator uses: shared tables, input columns, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


_held: dict = {}


def held(name: tuple, make):
    """The one large object (a model, an encoder with its memo) that this Python process keeps for its next tasks. Another
    name makes room first, so stages that follow each other in one process do not add up."""
    if name not in _held:
        make_room()
        _held[name] = make()
    return _held[name]


def make_room() -> None:
    _held.clear()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Tasks get this many rows at once while it lasts: for rows that hold whole texts, whose batches count in a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets one of its own;
    a cluster must name one, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and lost executors
    read the files again instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a ``shared_table`` whose rows nothing needs any more."""
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [x for x in _written if any(r.endswith(x[1].split(":", 1)[-1]) for r in roots)]:
        _remove(*entry)
        _written.remove(entry)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tasks(df: DataFrame, at_least: int = 1) -> int:
    """Partitions for a shuffle of ``df``: the session's setting, which the cluster sizes to its data."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows (a key and a digest each) that are broadcast at most; more meet the table by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def among(df: DataFrame, key: str, digest: Column, rows: DataFrame, how: str) -> DataFrame:
    """``df`` joined (left_semi or left_anti) with ``rows``, a written table of doc_id and text_hash. A null key is a key."""
    one, two = unused(df, "__key"), unused(df, "__digest")
    there = bounded(rows.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)))
    return df.join(there, F.col(key).cast("long").eqNullSafe(F.col(one)) & (digest == F.col(two)), how)


def one_of_each(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The row of ``df`` with the smallest key (then text hash) of each group. ``found``: doc_id, text_hash and root, which
    names the group, of all rows with a key. Rows that are equal in key and text count once; rows without a key stay."""
    found = shared_table(found, "groups")
    least = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    gone = shared_table(found.join(least, "root").where(F.struct("doc_id", "text_hash") != F.col("least")).select("doc_id", "text_hash").distinct(), "gone")
    again = shared_table(found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "again")
    digest = F.xxhash64(text_or_empty(text))
    kept = among(df, key, digest, gone, "left_anti")
    if not again.count():
        return kept
    repeated = among(kept, key, digest, again, "left_semi").withColumn(name := unused(df, "__digest"), digest)
    return among(kept, key, digest, again, "left_anti").unionByName(repeated.dropDuplicates([key, name]).drop(name))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``order``, a column of different whole numbers. Sums are
    taken within runs of 4,096 numbers and then over the runs, so no task orders all rows. ``df`` is a written table."""
    from pyspark.sql import Window as W

    run = F.shiftright(F.col(order).cast("long"), 12)
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = df.groupBy(run.alias("__run")).agg(F.sum(value).alias("__sum"))
    starts = runs.select("__run", before(W.orderBy("__run"), "__sum").alias("__start"))
    inside = df.withColumn("__run", run).withColumn("__own", before(W.partitionBy("__run").orderBy(order), value))
    return inside.join(starts, "__run").withColumn(name, F.col("__own") + F.col("__start")).drop("__run", "__own", "__start")


def open_store(uri: str):
    """The file system of a path in the shared folder, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def sorted_table(df: DataFrame, order: list, label: str, rows: int, rows_per_part: int = 20_000, name: str = "__at") -> DataFrame:
    """``df`` as a written table in ascending ``order``: ``name`` is a row's place, partition * 2**33 + place inside it.

    Rows are dealt to ranges of the whole order and, where that ends in a tie, of their places in ``df``: a value that
    many rows share is spread as well, and no cut points pass through the driver's code.
    """
    parts, by = max(1, -(-rows // rows_per_part)), [*order, F.col("__tie")]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    return shared_table(tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie").withColumn(name, F.monotonically_increasing_id()), label)


def ranked(df: DataFrame, key: str, order: list, name: str, rows: int) -> DataFrame:
    """Adds a gapless rank from 0 within ``key``, in ``order``. No task holds all rows of a key: rows lie in ranges of
    (key, order), and the ranges' counts, a small table, give where each begins."""
    from pyspark.sql import Window as W

    placed = sorted_table(df, [F.col(key), *order], "ranked", rows).withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__s"))
    joined = placed.join(starts, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, F.col("__at") + F.col("__s")).drop("__k", "__p", "__s", "__at", "__part")
