"""Readers of small artifact formats over ``binaryFile`` rows (path, content), and checked exports of tiles.

Headers are bytes and archives, which columns cannot take apart: each file is one row of an Arrow batch, and what comes
out are rows for Spark to check.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import ContractError

ENVI = ("samples", "lines", "bands", "header offset", "data type", "interleave", "byte order")
#: JPEG markers that give the frame's size, and those that stand alone.
FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})
ALONE = frozenset({0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)})


def envi_headers(lines: DataFrame) -> DataFrame:
    """One row per file of ``lines`` (path, line number n, value): its required fields. A file without the signature, with a
    repeated key or without a field has ``fault`` set instead of being left out."""
    pair = F.split("value", "=", 2)
    keyed = lines.select("path", "n", F.trim("value").alias("value"), F.when(F.col("value").contains("=") & (F.col("n") > 0), F.lower(F.trim(pair[0]))).alias("key"), F.trim(F.get(pair, F.lit(1))).alias("field"))
    own = keyed.groupBy("path").agg(
        F.bool_or((F.col("n") == 0) & (F.col("value") == "ENVI")).alias("signed"), (F.count("key") != F.count_distinct("key")).alias("repeats"),
        *[F.max(F.when(F.col("key") == k, F.col("field"))).alias(k.replace(" ", "_")) for k in ENVI],
    )
    names = [k.replace(" ", "_") for k in ENVI]
    whole = [n for n in names if n != "interleave"]
    missing = F.array_contains(F.array(*[F.col(n).isNull() for n in names]), True)
    odd = F.array_contains(F.array(*[~F.col(n).rlike("^[0-9]+$") for n in whole]), True)
    fault = F.when(~F.col("signed"), "no signature").when(F.col("repeats"), "repeated key").when(missing, "missing field").when(odd, "not a whole number")
    return own.select("path", *[F.col(n).try_cast("long").alias(n) for n in whole], F.lower("interleave").alias("interleave"), fault.alias("fault"))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a JPEG from its markers, without decoding it; null if it is none or cut off."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := data.find(b"\xff", at)) >= 0:
        while data[at : at + 1] == b"\xff":
            at += 1
        code, at = data[at : at + 1], at + 1
        if not code:
            return None
        if code[0] in ALONE:
            continue
        length = data[at : at + 2]
        if len(length) < 2 or (size := struct.unpack(">H", length)[0]) < 2:
            return None
        if code[0] in FRAMES:
            frame = data[at + 3 : at + 7]
            high, wide = struct.unpack(">HH", frame) if len(frame) == 4 else (0, 0)
            return (wide, high) if wide and high else None
        at += size
    return None


def jpeg_sizes(files: DataFrame) -> DataFrame:
    """path, width and height (null if the file is no JPEG) of ``binaryFile`` rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [jpeg_size(bytes(c)) or (None, None) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})

    return files.select("path", "content").mapInPandas(read, "path string, width int, height int")


def archive_members(files: DataFrame) -> DataFrame:
    """path, name, bytes, sha256 and fault of each member of zip archives, by name. Repeated names, names that leave the
    archive's folder and files that are no archive are faults."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "not an archive"))
                    continue
                seen: set[str] = set()
                for info in sorted(archive.infolist(), key=lambda x: x.filename):
                    parts = info.filename.split("/")
                    fault = "unsafe name" if info.filename.startswith("/") or ".." in parts else "repeated name" if info.filename in seen else None
                    seen.add(info.filename)
                    if not info.is_dir():
                        with archive.open(info) as source:
                            digest = hashlib.file_digest(source, "sha256").hexdigest()
                        rows.append((path, info.filename, info.file_size, digest, fault))
            yield pd.DataFrame(rows, columns=["path", "name", "bytes", "sha256", "fault"]).astype({"bytes": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, name string, bytes long, sha256 string, fault string")


def scene_leaves(pages: DataFrame) -> DataFrame:
    """index of each leaf of node pages (nodes: array of index, mesh, children): nodes with a mesh and no children."""
    each = pages.select(F.explode("nodes").alias("n")).where(F.col("n.mesh").isNotNull() & F.col("n.children").isNull())
    return each.select(F.col("n.index").cast("long").alias("index"))


def require_contiguous(leaves: DataFrame) -> None:
    """Leaves must be numbered from 1 without gap or repeat."""
    n, different, least, most = leaves.agg(F.count(F.lit(1)), F.count_distinct("index"), F.min("index"), F.max("index")).first()
    if not n or (n, least, most) != (different, 1, n):
        raise ContractError(f"{n} leaves, {different} different ones from {least} to {most}")


def tile_inventory(tiles: DataFrame) -> DataFrame:
    """Inventory lines ``z/x/y/bytes/sha256`` of tiles with content."""
    return tiles.select("z", "x", "y", F.concat_ws("/", "z", "x", "y", F.octet_length("content"), F.sha2("content", 256)).alias("line"))


def export(tiles: DataFrame, path: str, most_files: int, most_bytes: int) -> DataFrame:
    """Write tiles as Parquet (z, x, y, bytes, sha256, content) if they are few and small enough together, and not otherwise."""
    made = tiles.select("z", "x", "y", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    n, total = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n > most_files or total > most_bytes:
        raise ContractError(f"{n} files of {total} bytes are more than {most_files} of {most_bytes}")
    made.write.mode("errorifexists").parquet(path)
    return tiles.sparkSession.read.parquet(path)


def publish_once(df: DataFrame, path: str) -> None:
    """Write an artifact set that never changes. A second run with the same rows does nothing; with other rows it fails."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("errorifexists").parquet(path)
        return
    there = spark.read.parquet(path)
    if there.columns != df.columns or there.exceptAll(df).limit(1).count() or df.exceptAll(there).limit(1).count():
        raise ContractError("the artifact set at this place holds other rows")
