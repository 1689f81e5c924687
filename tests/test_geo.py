"""Coordinate systems, GeoParquet, well-known binary, the conic zone and its inverse."""

import json
import struct
from glob import glob
from hashlib import sha256
from math import cos, radians, sin, sqrt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.sources import geo

BOX = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]]


def table(spark, rows):
    return spark.createDataFrame(rows, f"id long, rings {geo.RINGS}")


def test_conic_zone(spark):
    """The origin, true scale on both standard parallels, and the way back to within a millimetre."""
    rows = [(lon / 10, lat / 10) for lon in range(-800, -740, 7) for lat in range(390, 420, 3)]
    df = spark.createDataFrame([*rows, (-77.75, 39 + 1 / 3)], "lon double, lat double")
    x, y = g.lambert(F.col("lon"), F.col("lat"))
    there = df.withColumns({"x": x, "y": y})
    lon, lat = g.lambert_inverse(F.col("x"), F.col("y"))
    got = there.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert all(abs(r.lon - r.lon2) * 85_000 < 1e-3 and abs(r.lat - r.lat2) * 111_000 < 1e-3 for r in got)
    assert (got[-1].x, got[-1].y) == (pytest.approx(600_000, abs=1e-6), pytest.approx(0, abs=1e-6))
    step = 1e-5
    for parallel in (39 + 56 / 60, 40 + 58 / 60):
        a, b = (spark.range(1).select(*[v.alias(n) for n, v in zip("xy", g.lambert(F.lit(-76 + d), F.lit(parallel)))]).first() for d in (0, step))
        e2 = (2 - 1 / 298.257222101) / 298.257222101
        radius = 6_378_137 / sqrt(1 - e2 * sin(radians(parallel)) ** 2) * cos(radians(parallel))
        assert sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (radius * radians(step)) == pytest.approx(1, abs=1e-7)


def test_projection_needs_a_system(spark):
    df = table(spark, [(1, [[(-75.1, 39.9), (-75.0, 39.9), (-75.0, 40.0)]])])
    with pytest.raises(geo.CrsError, match="no coordinate system"):
        geo.projected(df)
    with pytest.raises(geo.CrsError, match="EPSG:2272"):
        geo.projected(geo.with_crs(df, "EPSG:2272"))
    metres = geo.projected(geo.with_crs(df, geo.DEGREES))
    assert geo.crs_of(metres) == geo.METRES and geo.projected(metres) is metres
    back = geo.unprojected(metres)
    assert geo.crs_of(back) == geo.DEGREES
    assert [[(round(p.x, 9), round(p.y, 9)) for p in ring] for ring in back.first().rings] == [[(-75.1, 39.9), (-75.0, 39.9), (-75.0, 40.0)]]


def test_binary_and_ids(spark):
    closed = [(0.0, 0.0), (0.0, 2.0), (4.0, 2.0), (4.0, 0.0), (0.0, 0.0)]
    want = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in closed)
    turned = [(k, [BOX[0][k:] + BOX[0][:k]]) for k in range(4)] + [(9, [BOX[0][::-1]])]
    got = table(spark, turned).select(geo.to_binary(F.col("rings")).alias("b"), geo.footprint_id(F.col("rings")).alias("f")).distinct().collect()
    assert [(bytes(r.b), r.f) for r in got] == [(want, sha256(want).hexdigest()[:24])]
    frame = [BOX[0], [(1.0, 0.5), (1.0, 1.0), (2.0, 1.0)], [(3.0, 0.5), (3.0, 1.0), (3.5, 1.0)]]
    again = geo.parse_polygon(geo.polygon_bytes([[{"x": x, "y": y} for x, y in r] for r in frame]))
    assert [len(r) for r in again] == [4, 3, 3] and {(p["x"], p["y"]) for r in again for p in r} == {p for r in frame for p in r}
    assert table(spark, [(1, None), (2, []), (3, [[(0.0, 0.0), (1.0, 1.0)]])]).where(geo.to_binary(F.col("rings")).isNotNull()).count() == 0
    for data, said in ((want[:-1], "cut off"), (want + b"x", "follow"), (b"\x00" + want[1:], "little-endian")):
        with pytest.raises(ValueError, match=said):
            geo.parse_polygon(data)


def test_geoparquet(spark, tmp_path):
    path = str(tmp_path / "figures")
    rows = [(k, [[(k * 10.0, 0.0), (k * 10.0 + 4, 0.0), (k * 10.0 + 4, 3.0)]]) for k in range(300)]
    df = geo.with_crs(table(spark, rows).repartition(5), geo.METRES)
    geo.write_geoparquet(df, path)
    meta = json.loads(pq.read_metadata(glob(f"{path}/*.parquet")[0]).metadata[b"geo"])
    assert meta["columns"]["rings"]["crs"]["id"] == {"authority": "EPSG", "code": "32129"} and meta["columns"]["rings"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    back = geo.read_geoparquet(spark, path)
    assert geo.crs_of(back) == geo.METRES and back.columns == ["id", "rings"]
    assert {r.id: {(p.x, p.y) for p in r.rings[0]} for r in back.collect()} == {k: set(r[0]) for k, r in rows}
    assert sorted(r.id for r in geo.read_geoparquet(spark, path, (95.0, 1.0, 121.0, 2.0)).collect()) == [10, 11, 12]
    assert not glob(f"{path}.stage*")
    plain = str(tmp_path / "plain")
    spark.range(3).write.parquet(plain)
    with pytest.raises(geo.CrsError, match="geo entry"):
        geo.read_geoparquet(spark, plain)
    with pytest.raises(geo.CrsError):
        geo.write_geoparquet(table(spark, rows), str(tmp_path / "none"))
