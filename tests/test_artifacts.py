"""Artifact readers, exports and window scans."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import contracts, views
from gridloom.sources import artifacts, layers


def test_envi_headers(spark):
    good = ["ENVI", "samples = 5", "lines=4", "bands = 1", "header offset = 0", "data type = 1", "interleave = BSQ", "byte order = 0", "note"]
    files = {"a": good, "b": good[1:], "c": [*good, "Lines = 9"], "d": good[:-2], "e": [x.replace("5", "-5") for x in good]}
    lines = spark.createDataFrame([(p, n, v) for p, rows in files.items() for n, v in enumerate(rows)], "path string, n int, value string")
    got = {r.path: r for r in artifacts.envi_headers(lines).collect()}
    assert (got["a"].samples, got["a"].lines, got["a"].interleave, got["a"].fault) == (5, 4, "bsq", None)
    assert [got[k].fault for k in "bcde"] == ["no signature", "repeated key", "missing field", "not a whole number"]


def test_jpeg_sizes(spark, tmp_path):
    frame = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\x01\x11\x00\x00"
    skipped = b"\xff\xe0" + struct.pack(">H", 6) + b"\xff\xc0zz"
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + skipped + b"\xff" + frame)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8" + frame[:6])
    (tmp_path / "c.jpg").write_bytes(b"GIF89a")
    rows = artifacts.jpeg_sizes(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {r.path[-5:]: (r.width, r.height) for r in rows} == {"a.jpg": (640, 480), "b.jpg": (None, None), "c.jpg": (None, None)}


def test_archive_members(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x/b.txt", "two")
        z.writestr("a.txt", "one")
        z.writestr("../c.txt", "out")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = [(r.name, r.bytes, r.fault) for r in artifacts.archive_members(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "name").collect()]
    assert got == [("../c.txt", 3, "unsafe name"), ("a.txt", 3, None), ("x/b.txt", 3, None), (None, None, "not an archive")]


def test_scene_leaves(spark, tmp_path):
    nodes = [{"index": 0, "children": [1, 2]}, {"index": 1, "mesh": {"id": 7}}, {"index": 2, "mesh": {"id": 8}}]
    (tmp_path / "p.json").write_text(json.dumps({"nodes": nodes}))
    pages = spark.read.schema("nodes array<struct<index:long,mesh:struct<id:long>,children:array<long>>>").json(str(tmp_path / "p.json"))
    leaves = artifacts.scene_leaves(pages)
    assert sorted(r["index"] for r in leaves.collect()) == [1, 2]
    artifacts.require_contiguous(leaves)
    for bad in (leaves.where("index = 2"), leaves.union(leaves), leaves.limit(0)):
        with pytest.raises(contracts.ContractError):
            artifacts.require_contiguous(bad)


def test_exports(spark, tmp_path):
    tiles = spark.range(5).select(F.lit(3).alias("z"), F.col("id").alias("x"), F.lit(0).alias("y"), F.encode(F.concat(F.lit("tile "), F.col("id").cast("string")), "utf-8").alias("content"))
    line = artifacts.tile_inventory(tiles).where("x = 1").first().line
    assert line.startswith("3/1/0/6/") and len(line.split("/")[4]) == 64
    with pytest.raises(contracts.ContractError):
        artifacts.export(tiles, f"{tmp_path}/too-many", 4, 1000)
    with pytest.raises(contracts.ContractError):
        artifacts.export(tiles, f"{tmp_path}/too-large", 9, 29)
    assert artifacts.export(tiles, f"{tmp_path}/site", 5, 30).count() == 5
    artifacts.publish_once(tiles, f"{tmp_path}/set")
    artifacts.publish_once(tiles, f"{tmp_path}/set")
    with pytest.raises(contracts.ContractError):
        artifacts.publish_once(tiles.where("x < 4"), f"{tmp_path}/set")


def test_window_conditions_reach_the_scan(spark, sf):
    ring = views.g.box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    path = views.write_with_boxes(layers.buildings(spark, sf).select("building_id", ring.alias("ring")), "ring")
    plan = views.read_window(spark, path, 0, 0, 100, 100).select("building_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.min_x" in plan.split("PushedFilters")[1]


def test_capture_times(spark):
    said = ["1970:01:01 00:01:00", "1970-01-02", "1970-01-01T01:00:00+01:00", "1970-01-01T00:00:01Z", "1970:13:01 00:00:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "v string").select(views.capture_time(F.col("v"))).collect()]
    assert got == [60, 86_400, 0, 1, None, None, None]
