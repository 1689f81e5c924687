"""Point files of the public LAS format (1.0 to 1.4, uncompressed) as a Spark data source.

``spark.dataSource.register(LasSource)``, then ``spark.read.format("las").load("/folder/*.las")``. A partition is a slice of
one file's records, read by seeking; a reader holds one Arrow batch at a time. Paths are any that Arrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE = 4_000_000
BATCH = 250_000
SCHEMA = "file string, x double, y double, z_raw int, z double, cls int"


@dataclass
class Header:
    version: tuple[int, int]
    start: int
    kind: int
    width: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def parse_header(data: bytes) -> Header:
    if len(data) < 227 or data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version = data[24], data[25]
    kind = data[104]
    if kind & 0xC0:
        raise ValueError("compressed points are not supported")
    start, (width,) = struct.unpack_from("<I", data, 96)[0], struct.unpack_from("<H", data, 105)
    (count,) = struct.unpack_from("<I", data, 107)
    if version >= (1, 4):
        if len(data) < 375:
            raise ValueError("the header is cut off")
        count = struct.unpack_from("<Q", data, 247)[0] or count
    if kind > 10 or not count:
        raise ValueError("no points, or of an unknown format")
    if width < (20 if kind < 6 else 30):
        raise ValueError("records are shorter than their format")
    return Header(version, start, kind, width, count, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155))


def points(data: bytes, head: Header) -> dict[str, np.ndarray]:
    """Whole records to columns; class bits 0-4 at byte 15 before format 6, byte 16 from it."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, head.width)
    xyz = raw[:, :12].copy().view("<i4")
    cls = raw[:, 16] if head.kind >= 6 else raw[:, 15] & 31
    x, y, z = (xyz[:, k] * head.scale[k] + head.offset[k] for k in range(3))
    return {"x": x, "y": y, "z_raw": xyz[:, 2].astype("int32"), "z": z, "cls": cls.astype("int32")}


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self._path = options.get("path", "")
        self._slice = int(options.get("slice", SLICE))

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, path = fs.FileSystem.from_uri(self._path) if "://" in self._path or self._path.startswith("file:") else (fs.LocalFileSystem(), self._path)
        folder = path.rsplit("/", 1)[0] if path.endswith(".las") else path
        if path.endswith(".las") and "*" not in path:
            return system, [path]
        found = system.get_file_info(fs.FileSelector(folder.rstrip("/"), recursive=True))
        return system, sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".las"))

    def partitions(self) -> list[Slice]:
        system, files = self._files()
        out = []
        for path in files:
            with system.open_input_file(path) as f:
                head, size = parse_header(f.read(375)), f.size()
            if head.start + head.count * head.width > size:
                raise ValueError(f"{path} has fewer points than its header says")
            out += [Slice(path, k, min(self._slice, head.count - k)) for k in range(0, head.count, self._slice)]
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = self._files() if "://" in self._path else (fs.LocalFileSystem(), [])
        with system.open_input_file(partition.path) as f:
            head = parse_header(f.read(375))
            for k in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - k)
                f.seek(head.start + k * head.width)
                columns = points(f.read(n * head.width), head)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), *map(pa.array, columns.values())], names=["file", *columns])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LasReader(self.options)
