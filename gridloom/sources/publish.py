"""Generations: a table is written to a folder of its own, checked, and made current by one small pointer file.

Readers follow the pointer, so they see the old rows or the new ones, never a mixture, and a writer that dies leaves
the old generation current. All files go through Spark's and Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


_PARTS = lambda columns: (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1_000_003))).alias("s"))


def checksum(df: DataFrame) -> list:
    row = df.agg(*_PARTS(df.columns)).first()
    return [row[0], row[1] or 0, row[2] or 0]


def stage(df: DataFrame, root: str, sort: list[str] | None = None) -> str:
    """Write ``df`` (zstd Parquet, sorted inside its files for tight statistics) to a generation of its own, read it back, and compare
    with a checksum taken of the rows while they were written: ``df`` is computed once."""
    spark = df.sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    seen = Observation()
    rows = df.observe(seen, *_PARTS(df.columns))
    rows = rows.sortWithinPartitions(*sort) if sort else rows
    rows.write.option("compression", "zstd").parquet(f"{root}/{name}")
    given = seen.get
    if checksum(spark.read.schema(df.schema).parquet(f"{root}/{name}")) != [given["n"], given["x"] or 0, given["s"] or 0]:
        raise ContractError("the written rows differ from those given; the old generation stays current")
    return name


def write_json(spark: SparkSession, path: str, said: dict) -> None:
    """Replace a small file in one step: readers see the old or the new one."""
    folder, name = path.rsplit("/", 1)
    system, where, jvm = _fs(spark, folder)
    fresh, target = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    out = system.create(fresh, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(fresh), system.makeQualified(target), option)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def make_current(spark: SparkSession, root: str, name: str, header: dict) -> None:
    write_json(spark, f"{root}/CURRENT.json", {**header, "generation": name})


def current_header(spark: SparkSession, root: str) -> dict:
    return read_json(spark, f"{root}/CURRENT.json")


def publish(df: DataFrame, root: str, sort: list[str] | None = None) -> str:
    """Stage ``df`` and make it current."""
    spark = df.sparkSession
    name = stage(df, root, sort)
    found = checksum(spark.read.schema(df.schema).parquet(f"{root}/{name}"))
    make_current(spark, root, name, {"rows": found[0], "checksum": found[1:]})
    return name


def current(spark: SparkSession, root: str, verify: bool = False) -> DataFrame:
    """The current generation; ``verify`` compares its rows with what was published."""
    said = current_header(spark, root)
    df = spark.read.parquet(f"{root}/{said['generation']}")
    if verify and checksum(df) != [said["rows"], *said["checksum"]]:
        raise ContractError("the current generation was changed after it was published")
    return df
