"""Figures with a coordinate system: the system travels with the column, in Spark's metadata and in GeoParquet's.

A ``rings`` column without a known system cannot be projected; that is an error and never a guess. Files are written by Spark's
tasks under names of their own and made visible once the job is done, by renaming those of the tasks that finished.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

# Identifiers of the two systems, longitude and latitude in degrees and the conic zone in metres.
DEGREES, METRES = "EPSG:4326", "EPSG:32129"
RINGS = "array<array<struct<x:double,y:double>>>"
_PIECE_ROWS = 20_000


class CrsError(ValueError):
    """A source has no coordinate system, or one that is not known here."""


def with_crs(df: DataFrame, crs: str, rings: str = "rings") -> DataFrame:
    return df.withMetadata(rings, {**df.schema[rings].metadata, "crs": crs})


def crs_of(df: DataFrame, rings: str = "rings") -> str:
    crs = df.schema[rings].metadata.get("crs")
    if not crs:
        raise CrsError(f"{rings} has no coordinate system")
    return crs


def _points(df: DataFrame, rings: str, move, crs: str) -> DataFrame:
    moved = F.transform(rings, lambda ring: F.transform(ring, lambda p: g.point(*move(p["x"], p["y"]))))
    return with_crs(df.withColumn(rings, moved), crs, rings)


def projected(df: DataFrame, rings: str = "rings") -> DataFrame:
    """The figures in metres."""
    crs = crs_of(df, rings)
    if crs == METRES:
        return df
    if crs != DEGREES:
        raise CrsError(f"{crs} cannot be projected to {METRES}")
    return _points(df, rings, g.lambert, METRES)


def unprojected(df: DataFrame, rings: str = "rings") -> DataFrame:
    """The figures in degrees."""
    crs = crs_of(df, rings)
    if crs == DEGREES:
        return df
    if crs != METRES:
        raise CrsError(f"{crs} cannot be brought to {DEGREES}")
    return _points(df, rings, g.lambert_inverse, DEGREES)


# well-known binary ---------------------------------------------------------------------------------------------------------


def _turned(ring: list[tuple[float, float]], clockwise: bool) -> list[tuple[float, float]]:
    """The ring from its least point, closed, in the wanted direction."""
    at = min(range(len(ring)), key=lambda k: ring[k])
    ring = ring[at:] + ring[:at]
    ox, oy = ring[0]
    area = sum((a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in zip(ring, [*ring[1:], ring[0]]))
    if (area < 0) != clockwise:
        ring = [ring[0], *reversed(ring[1:])]
    return [*ring, ring[0]]


def polygon_bytes(rings) -> bytes | None:
    """Well-known binary of a polygon in normal form: every ring from its least point, the shell clockwise, holes the other way
    round and sorted. Null for a figure without a shell of three points."""
    if rings is None or len(rings) == 0 or len(rings[0]) < 3:
        return None
    points = [[(p["x"], p["y"]) for p in ring] for ring in rings if len(ring) >= 3]
    turned = [_turned(points[0], True), *sorted(_turned(r, False) for r in points[1:])]
    return struct.pack("<BII", 1, 3, len(turned)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in p)) for r in turned)


def parse_polygon(data: bytes) -> list[list[dict]]:
    """Rings, not closed. Other figures, cut data and bytes that follow are errors."""
    try:
        order, kind, n = struct.unpack_from("<BII", data)
        if (order, kind) != (1, 3):
            raise ValueError("not a little-endian polygon")
        at, out = 9, []
        for _ in range(n):
            (m,) = struct.unpack_from("<I", data, at)
            flat = struct.unpack_from(f"<{2 * m}d", data, at + 4)
            at += 4 + 16 * m
            out.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])][:-1])
    except struct.error as e:
        raise ValueError("the polygon is cut off") from e
    if at != len(data):
        raise ValueError("bytes follow the polygon")
    return out


def to_binary(rings: Column) -> Column:
    @F.pandas_udf("binary")
    def made(values: pd.Series) -> pd.Series:
        return pd.Series([polygon_bytes(v) for v in values], dtype=object)

    return made(rings)


def from_binary(data: Column) -> Column:
    @F.pandas_udf(RINGS)
    def made(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else parse_polygon(bytes(v)) for v in values], dtype=object)

    return made(data)


def footprint_id(rings: Column) -> Column:
    """24 hexadecimal digits that name a figure, however its rings are turned: of the digest of its normal form."""
    return F.substring(F.sha2(to_binary(rings), 256), 1, 24)


# GeoParquet ----------------------------------------------------------------------------------------------------------------


def _store(path: str):
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write_geoparquet(df: DataFrame, path: str, rings: str = "rings", cell: float = 64.0) -> None:
    """``df`` as GeoParquet 1.1 in the new folder ``path``: figures as well-known binary, a covering ``bbox`` column, the system and
    the kinds of figures in the files' ``geo`` entry, rows in Morton order so that row groups have small boxes. The folder
    appears when all files are there."""
    crs = crs_of(df, rings)
    others = [c for c in df.columns if c != rings]
    boxed = df.where(F.size(rings) > 0).withColumn("bbox", F.struct(*[v.alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), g.rings_box(F.col(rings)).values())]))
    code = g.morton(F.floor(F.col("bbox.xmin") / cell), F.floor(F.col("bbox.ymin") / cell))
    flat = boxed.withColumn("__code", code).select(*others, to_binary(F.col(rings)).alias(rings), "bbox", "__code")
    dealt = flat.repartitionByRange("__code").sortWithinPartitions("__code").drop("__code")
    cover = {n: ["bbox", n] for n in ("xmin", "ymin", "xmax", "ymax")}
    geo = {"version": "1.1.0", "primary_column": rings, "columns": {rings: {"encoding": "WKB", "geometry_types": ["Polygon"], "crs": {"id": dict(zip(("authority", "code"), crs.split(":")))}, "covering": {"bbox": cover}}}}
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, f"{uuid.uuid4().hex}.parquet"
        store, inner = _store(stage)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(inner)
                schema = batch.schema.with_metadata({**(batch.schema.metadata or {}), b"geo": json.dumps(geo).encode()})
                writer = pq.ParquetWriter(f"{inner}/{name}", schema, filesystem=store, compression="zstd")
            writer.write_table(pa.Table.from_batches([batch]).replace_schema_metadata(writer.schema.metadata), row_group_size=_PIECE_ROWS)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r.name for r in dealt.mapInArrow(write, "name string").collect()]  # one short row a file
    store, inner = _store(stage)
    _, final = _store(path)
    store.create_dir(inner)
    done = f"{inner}/done"
    store.create_dir(done)
    for k, name in enumerate(names):
        store.move(f"{inner}/{name}", f"{done}/part-{k:06d}.parquet")
    store.move(done, final)
    store.delete_dir(inner)


def read_geoparquet(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The rows, figures as rings that bear their system. Files without a ``geo`` entry, or whose entries differ, are refused.
    Rows whose box misses the window are left out; the conditions reach the scan."""
    store, inner = _store(path)
    files = [f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
    if not files:
        raise CrsError(f"{path} has no files")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"geo": [(pq.read_metadata(f, filesystem=store).metadata or {}).get(b"geo") for f in batch["file"]]})

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 256))
    held = [r.geo for r in names.mapInPandas(entries, "geo binary").distinct().collect()]
    if len(held) != 1 or held[0] is None:
        raise CrsError(f"{path} holds files without a geo entry, or with different ones")
    geo = json.loads(held[0])
    rings = geo["primary_column"]
    system = geo["columns"][rings].get("crs")
    if not system:
        raise CrsError(f"{path} has no coordinate system")
    df = spark.read.parquet(path)
    if window:
        b = lambda c: F.col(f"bbox.{c}")
        df = df.where((b("xmin") <= window[2]) & (b("xmax") >= window[0]) & (b("ymin") <= window[3]) & (b("ymax") >= window[1]))
    return with_crs(df.withColumn(rings, from_binary(F.col(rings))).drop("bbox"), f"{system['id']['authority']}:{system['id']['code']}", rings)
