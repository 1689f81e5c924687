"""The packed world: all layers as records of one binary file, written in slices by a Spark data source and read again.

A world is a folder of slices, whose bytes one after the other are the file, and a manifest. Layers become one table of
records (section, ord, record), dealt to ranges of that order; every task writes one slice and reports the bytes and records
of each section in it. The commit adds these up to the sections' offsets and writes the manifest, which makes the world
visible; an aborted job leaves none. A reader's partition is one slice: it checks the slice's size and digest, seeks to its
section and parses records no further than the section goes. A whole file, without a manifest, is read by one task.

``spark.dataSource.register(PackedWorld)``, then ``spark.read.format("packed_world").option("layer", "trees").load(folder)``.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The format's mark, versions, coordinate system and limits.
MARK = b"GEOPHILY"
VERSION, OLDEST = 12, 9
EPSG = 32129
UNKNOWN_EDGE = 255
MOST_HEIGHT = 400.0
LEAST_DIAMETER, MOST_DIAMETER = 0.0254, 2.0
MOST_LINE_POINTS = 100_000

_RING = "array<struct<x:double,y:double>>"
#: Layers in the file's order, and their columns beside ``ord``.
LAYERS = {
    "buildings": f"height double, ring {_RING}, frontage int",
    "parts": f"osm_id long, height double, min_height double, roof_height double, roof_shape int, ring {_RING}",
    "meshes": f"texture_id long, height double, ring {_RING}, faces array<array<struct<x:double,y:double,z:double,u:double,v:double>>>",
    "city": f"ring {_RING}",
    "water": f"ring {_RING}",
    "parks": f"ring {_RING}",
    "trees": "x double, y double, diameter double, form int",
    "transport": f"kind int, ring {_RING}",
}
SECTIONS = list(LAYERS)
_NAMES = {
    "buildings": ("height", "ring", "frontage"), "parts": ("osm_id", "height", "min_height", "roof_height", "roof_shape", "ring"), "meshes": ("texture_id", "height", "ring", "faces"),
    "city": ("ring",), "water": ("ring",), "parks": ("ring",), "trees": ("x", "y", "diameter", "form"), "transport": ("kind", "ring"),
}
_WHOLE = ("frontage", "form", "kind", "roof_shape", "texture_id", "osm_id")


class WorldError(ValueError):
    """The bytes, or the rows to be written, are no valid world."""


def _need(fine: bool, what: str) -> None:
    if not fine:
        raise WorldError(what)


# records: one packer and one parser for each layer -----------------------------------------------------------------------


def _pack_ring(points, least: int = 3) -> bytes:
    _need(points is not None and len(points) >= least, f"a ring needs {least} points")
    flat = [v for p in points for v in (p["x"], p["y"])]
    _need(all(map(math.isfinite, flat)), "a coordinate is not finite")
    return struct.pack(f"<I{len(flat)}f", len(points), *flat)


def _check(layer: str, r) -> None:
    """The format's rules for one record, on writing and reading."""
    if layer == "buildings":
        _need(r["frontage"] is None or 0 <= r["frontage"] < min(len(r["ring"]), UNKNOWN_EDGE), "the frontage is no edge of its ring")
    elif layer == "parts":
        _need(0 <= r["height"] <= MOST_HEIGHT and 0 <= r["min_height"] < r["height"] and 0 <= r["roof_height"] <= r["height"] - r["min_height"], "heights of a part are out of range")
    elif layer == "meshes":
        _need(0 < r["height"] <= MOST_HEIGHT and len(r["faces"]) > 0 and all(len(f) == 3 for f in r["faces"]), "a mesh needs a height and triangles")
    elif layer == "trees":
        _need(LEAST_DIAMETER - 1e-9 <= r["diameter"] <= MOST_DIAMETER, "a tree's diameter is out of range")
    elif layer == "transport":
        _need(2 <= len(r["ring"]) <= MOST_LINE_POINTS, "a line's number of points is out of range")


def pack(layer: str, r) -> bytes:
    _check(layer, r)
    if layer == "buildings":
        return struct.pack("<f", r["height"]) + _pack_ring(r["ring"]) + bytes([UNKNOWN_EDGE if r["frontage"] is None else r["frontage"]])
    if layer == "parts":
        return struct.pack("<QfffB", r["osm_id"], r["height"], r["min_height"], r["roof_height"], r["roof_shape"]) + _pack_ring(r["ring"])
    if layer == "meshes":
        corners = [v for face in r["faces"] for p in face for v in (p["x"], p["y"], p["z"], p["u"], p["v"])]
        _need(all(map(math.isfinite, corners)), "a corner is not finite")
        return struct.pack("<IfI", r["texture_id"], r["height"], len(r["faces"])) + _pack_ring(r["ring"]) + struct.pack(f"<{len(corners)}f", *corners)
    if layer == "trees":
        return struct.pack("<fffB", r["x"], r["y"], r["diameter"], r["form"])
    if layer == "transport":
        return bytes([r["kind"]]) + _pack_ring(r["ring"], 2)
    return _pack_ring(r["ring"])


@dataclass
class Cursor:
    """A stretch of bytes, read from the front; what lies beyond it is an error, never a short result."""

    data: memoryview
    at: int = 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        _need(size <= len(self.data) - self.at, "the data are cut off")
        found = struct.unpack_from(form, self.data, self.at)
        self.at += size
        _need(all(not isinstance(v, float) or math.isfinite(v) for v in found), "a number is not finite")
        return found

    def items(self, n: int, width: int) -> None:
        _need(n * width <= len(self.data) - self.at, "more items are announced than there are data for")

    def ring(self, least: int = 3) -> list[dict]:
        (n,) = self.take("<I")
        _need(n >= least, f"a ring needs {least} points")
        self.items(n, 8)
        flat = self.take(f"<{2 * n}f")
        return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])]


def parse(layer: str, c: Cursor, version: int = VERSION) -> dict:
    if layer == "buildings":
        (height,) = c.take("<f")
        r = {"height": height, "ring": c.ring(), "frontage": None}
        edge = c.take("<B")[0] if version >= 12 else UNKNOWN_EDGE
        r["frontage"] = None if edge == UNKNOWN_EDGE else edge
    elif layer == "parts":
        r = dict(zip(("osm_id", "height", "min_height", "roof_height", "roof_shape"), c.take("<QfffB"))) | {"ring": c.ring()}
    elif layer == "meshes":
        texture, height, n = c.take("<IfI")
        c.items(n, 60)
        r = {"texture_id": texture, "height": height, "ring": c.ring()}
        r["faces"] = [[dict(zip("xyzuv", c.take("<5f"))) for _ in range(3)] for _ in range(n)]
    elif layer == "trees":
        r = dict(zip(("x", "y", "diameter"), c.take("<fff"))) | {"form": c.take("<B")[0] if version >= 11 else 0}
    elif layer == "transport":
        r = {"kind": c.take("<B")[0], "ring": c.ring(2)}
    else:
        r = {"ring": c.ring()}
    _check(layer, r)
    return r


def header(counts: dict[str, int], texture: bytes, bounds: tuple[float, float, float, float]) -> bytes:
    _need(len(texture) == 32, "the textures' digest has 32 bytes")
    return MARK + struct.pack(f"<II{len(SECTIONS)}I", VERSION, EPSG, *(counts.get(s, 0) for s in SECTIONS)) + texture + struct.pack("<4d", *bounds)


def parse_header(c: Cursor) -> tuple[int, dict[str, int]]:
    """Version, and how many records each section has."""
    _need(bytes(c.data[:8]) == MARK, "not a packed world")
    c.at = 8
    version, epsg = c.take("<II")
    _need(OLDEST <= version <= VERSION, f"version {version} is not supported")
    _need(epsg == EPSG, f"the coordinate system {epsg} is not supported")
    names = SECTIONS if version >= 10 else SECTIONS[:-1]
    counts = dict(zip(names, c.take(f"<{len(names)}I")))
    c.take("<32s4d")
    return version, counts


# writing ---------------------------------------------------------------------------------------------------------------


def _store(path: str):
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def records(layers: dict[str, DataFrame]) -> DataFrame:
    """(section, ord, record) of all layers; ``ord`` is the order inside a layer."""
    unknown = set(layers) - set(LAYERS)
    _need(bool(layers) and not unknown, f"unknown layers {sorted(unknown)}, or none")

    def packer(layer: str):
        @F.pandas_udf("binary")
        def packed(rows: pd.DataFrame) -> pd.Series:
            # whole numbers that may be null come as floats
            whole = lambda v: None if pd.isna(v) else int(v)
            clean = ({k: whole(v) if k in _WHOLE else v for k, v in r.items()} for r in rows.to_dict("records"))
            return pd.Series([pack(layer, r) for r in clean], dtype=object)

        return packed

    tables = []
    for layer, df in layers.items():
        row = F.struct(*[F.col(c) for c in _NAMES[layer]])
        tables.append(df.select(F.lit(SECTIONS.index(layer)).alias("section"), F.col("ord").cast("long").alias("ord"), packer(layer)(row).alias("record")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def write_world(layers: dict[str, DataFrame], path: str, bounds: tuple[float, float, float, float], texture: bytes = bytes(32), slices: int = 8) -> None:
    """Write the layers as a packed world into the new folder ``path``."""
    table = records(layers)
    spark = table.sparkSession
    spark.dataSource.register(PackedWorld)
    dealt = table.repartitionByRange(slices, "section", "ord").sortWithinPartitions("section", "ord")
    dealt.write.format("packed_world").option("bounds", json.dumps(list(bounds))).option("texture", texture.hex()).mode("append").save(path)


@dataclass
class Slice(WriterCommitMessage):
    part: int
    name: str
    size: int
    sha256: str
    sections: dict[str, list[int]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.bounds, self.texture = tuple(json.loads(options["bounds"])), bytes.fromhex(options["texture"])

    def write(self, iterator) -> Slice:
        part = TaskContext.get().partitionId()
        name = f"slice-{part:06d}-{uuid.uuid4().hex}.bin"
        store, folder = _store(self.path)
        store.create_dir(folder)
        digest, size, sections = hashlib.sha256(), 0, {}
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                held = sections.setdefault(SECTIONS[row.section], [0, 0])
                held[0] += 1
                held[1] += len(row.record)
                size += len(row.record)
                digest.update(row.record)
                out.write(bytes(row.record))
        return Slice(part, name, size, digest.hexdigest(), sections)

    def commit(self, messages) -> None:
        slices = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        counts = {s: sum(m.sections.get(s, [0, 0])[0] for m in slices) for s in SECTIONS}
        head = header(counts, self.texture, self.bounds)
        at, offsets = len(head), {}
        for s in SECTIONS:
            offsets[s] = at
            at += sum(m.sections.get(s, [0, 0])[1] for m in slices)
        _need(at == len(head) + sum(m.size for m in slices), "the slices' sections do not add up")
        said = {"header": head.hex(), "size": at, "counts": counts, "offsets": offsets, "slices": [vars(m) for m in slices]}
        store, folder = _store(self.path)
        with store.open_output_stream(f"{folder}/.manifest.json") as out:
            out.write(json.dumps(said).encode())
        store.move(f"{folder}/.manifest.json", f"{folder}/manifest.json")

    def abort(self, messages) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


# reading ---------------------------------------------------------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    """A slice's records of one layer, or, without a digest, a whole file."""

    path: str
    start: int
    size: int
    n: int
    first: int
    whole: int = 0
    sha256: str = ""


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layer = options["path"].rstrip("/"), options.get("layer", "buildings")
        _need(self.layer in LAYERS, f"there is no layer {self.layer}")

    def partitions(self) -> list[Stretch]:
        store, inner = _store(self.path)
        if store.get_file_info(inner).type == fs.FileType.File:
            return [Stretch(self.path, 0, -1, 0, 0)]
        with store.open_input_file(f"{inner}/manifest.json") as source:
            said = json.loads(source.read())
        parse_header(Cursor(memoryview(bytes.fromhex(said["header"]))))
        out, first = [], 0
        for s in said["slices"]:
            n, size = s["sections"].get(self.layer, (0, 0))
            before = sum(v[1] for k, v in s["sections"].items() if SECTIONS.index(k) < SECTIONS.index(self.layer))
            if n:
                out.append(Stretch(f"{self.path}/{s['name']}", before, size, n, first, s["size"], s["sha256"]))
            first += n
        _need(first == said["counts"][self.layer], "the manifest's slices do not add up")
        return out or [Stretch("", 0, 0, 0, 0)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        names = ("ord", *_NAMES[self.layer])
        if not part.path:
            return
        store, inner = _store(part.path)
        with store.open_input_file(inner) as source:
            data = source.read()
        if part.size < 0:
            c = Cursor(memoryview(data))
            version, counts = parse_header(c)
            for layer in SECTIONS:
                for k in range(counts.get(layer, 0)):
                    row = parse(layer, c, version) | {"ord": k}
                    if layer == self.layer:
                        yield tuple(row[n] for n in names)
            _need(c.at == len(data), "bytes follow the last record")
            return
        _need(len(data) == part.whole and hashlib.sha256(data).hexdigest() == part.sha256, f"{part.path} was changed or cut off")
        c = Cursor(memoryview(data)[part.start : part.start + part.size])
        for k in range(part.n):
            row = parse(self.layer, c) | {"ord": part.first + k}
            yield tuple(row[n] for n in names)
        _need(c.at == part.size, "bytes follow the section's last record")


class PackedWorld(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_world"

    def schema(self) -> str:
        return "ord long, " + LAYERS[self.options.get("layer", "buildings")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def export_file(spark: SparkSession, folder: str, target: str) -> None:
    """One file from a world's slices, copied by one task piece by piece, moved into place at the end."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                store, inner = _store(folder)
                to, out_path = _store(target)
                with store.open_input_file(f"{inner}/manifest.json") as source:
                    said = json.loads(source.read())
                with to.open_output_stream(f"{out_path}.part") as out:
                    out.write(bytes.fromhex(said["header"]))
                    for s in said["slices"]:
                        with store.open_input_stream(f"{inner}/{s['name']}") as source:
                            while piece := source.read(1 << 20):
                                out.write(piece)
                to.move(f"{out_path}.part", out_path)
            yield batch

    spark.range(1, numPartitions=1).mapInPandas(copy, "id long").collect()
