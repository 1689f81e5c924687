"""Readers, publishing, the queue, and small goldens of operators without SQL."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry, text
from gridloom.operators import context, contracts, raster
from gridloom.sources import las, publish, vector
from gridloom.streaming import queue


def las_bytes(points, kind=6, version=(1, 4)):
    width = 30 if kind >= 6 else 20
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes(version)
    struct.pack_into("<HI", head, 94, 375, 375)
    head[104] = kind
    struct.pack_into("<HI", head, 105, width, len(points))
    struct.pack_into("<3d3d", head, 131, 0.5, 0.5, 0.01, 100, 200, 0)
    struct.pack_into("<Q", head, 247, len(points))
    body = b""
    for x, y, z, cls in points:
        record = bytearray(width)
        struct.pack_into("<3i", record, 0, x, y, z)
        record[16 if kind >= 6 else 15] = cls
        body += record
    return bytes(head) + body


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_bytes([(k, 2 * k, 100 + k, 2 + k % 2 * 4) for k in range(25)]))
    (tmp_path / "b.las").write_bytes(las_bytes([(1, 1, 5, 6 | 32)], kind=1, version=(1, 2)))
    spark.dataSource.register(las.LasSource)
    frame = spark.read.format("las").option("slice", "10").load(str(tmp_path))
    rows = sorted(frame.collect(), key=lambda r: (r.file, r.x))
    assert len(rows) == 26 and frame.rdd.getNumPartitions() == 4
    assert (rows[3].x, rows[3].y, rows[3].z_raw, rows[3].z, rows[3].cls) == (101.5, 203.0, 103, pytest.approx(1.03), 6)
    assert rows[-1].cls == 6
    old = bytearray(las_bytes([(1, 2, 3, 2)]))
    struct.pack_into("<Q", old, 247, 0)
    assert las.parse_header(bytes(old)).count == 1  # the legacy count holds where the longer one is not given
    for bad in (las_bytes([(1, 2, 3, 2)], kind=6 | 128), las_bytes([]), las_bytes([(1, 2, 3, 2)], kind=11)):
        with pytest.raises(ValueError):
            las.parse_header(bad)


def test_vector_sources(spark, tmp_path):
    square = [{"lat": a, "lon": b} for a, b in ((0, 0), (0, 1), (1, 1), (0, 0))]
    elements = [{"type": "way", "id": 1, "tags": {"building:part": "yes", "height": "12 m"}, "geometry": square}, {"type": "node", "id": 2}, {"type": "way", "id": 3, "tags": {}, "geometry": square}]
    (tmp_path / "parts.json").write_text(json.dumps({"elements": elements}))
    assert [r.id for r in vector.building_parts(spark, str(tmp_path / "parts.json")).collect()] == [1]
    (tmp_path / "cut.json").write_text(json.dumps({"remark": "timeout", "elements": elements}))
    with pytest.raises(Exception, match="timeout"):
        vector.building_parts(spark, str(tmp_path / "cut.json")).collect()
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "x"}, "geometry": shape}]}))
    assert len(vector.polygons(spark, str(tmp_path / "f.json")).first().ring) == 3
    both = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
    (tmp_path / "m.json").write_text(json.dumps({"features": [{"properties": {"name": "y"}, "geometry": both}]}))
    assert [(len(r.ring), [len(h) for h in r.holes]) for r in vector.polygons(spark, str(tmp_path / "m.json")).collect()] == [(3, [3]), (3, [])]
    (tmp_path / "e.json").write_text(json.dumps({"features": []}))
    with pytest.raises(Exception, match="no features"):
        vector.polygons(spark, str(tmp_path / "e.json")).collect()
    pages = spark.createDataFrame([(1, '<a href="26453E230645N.las">a</a><a href="26453E230645N.las">b</a><a href="x.txt">')], "id int, html string")
    got = vector.listing(pages, ["id"], ".las").withColumn("b", vector.tile_bounds(F.col("name"))).collect()
    names = spark.createDataFrame([(1, '<a href="b.las"><a href="a.LAS"><a href="b.las">')], "id int, html string")
    assert [(r.name, r.place) for r in vector.listing(names, ["id"], ".las").collect()] == [("a.LAS", 0), ("b.las", 1)]
    assert len(got) == 1 and (got[0].b.min_x, got[0].b.min_y) == (2645300.0, 23064500.0)


def test_publish(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    publish.publish(spark.range(10).withColumn("v", F.col("id") * 2), root, ["id"])
    publish.publish(spark.range(4).withColumn("v", F.col("id")), root)
    assert publish.current(spark, root, verify=True).count() == 4
    publish.current(spark, root).limit(1).write.mode("append").parquet(f"{root}/" + publish.current(spark, root).inputFiles()[0].split("/")[-2])
    with pytest.raises(contracts.ContractError):
        publish.current(spark, root, verify=True)


def test_queue_resumes(spark, tmp_path):
    source, ledger = f"{tmp_path}/in", f"{tmp_path}/ledger"
    schema = T.StructType().add("tile", "string").add("bytes", "long")
    add = lambda *names: spark.createDataFrame([(n, 1) for n in names], schema).coalesce(1).write.mode("append").parquet(source)
    fail_b = lambda rows: rows.select("tile", F.when(F.col("tile") == "b", "failed").otherwise("done").alias("status"))
    good = lambda rows: rows.select("tile", F.lit("done").alias("status"))
    add("a", "b")
    queue.start(spark, source, schema, "tile", fail_b, ledger, f"{tmp_path}/cp").awaitTermination()
    selected = spark.read.parquet(source)
    assert [r.tile for r in queue.pending(selected, spark.read.parquet(ledger), "tile").collect()] == ["b"]
    add("c")
    queue.start(spark, source, schema, "tile", good, ledger, f"{tmp_path}/cp").awaitTermination()
    assert queue.pending(selected, spark.read.parquet(ledger), "tile").count() == 0
    tries = {r.tile: r.tries for r in queue.latest(spark.read.parquet(ledger), "tile").collect()}
    assert tries == {"a": 1, "b": 2, "c": 1}


def test_row_run_and_lone_house(spark):
    ring = "array(struct(x0 as x, 0d as y), struct(x0 + 5 as x, 0d as y), struct(x0 + 5 as x, 16d as y), struct(x0 as x, 16d as y)) as ring"
    rows = [(k, 5.0 * k, 9.3) for k in range(5)] + [(9, 100.0, 9.0)]
    houses = spark.createDataFrame(rows, "id long, x0 double, height double").selectExpr("id", "height", ring)
    got = {r.id: r for r in context.contexts(houses, "id", 32.0).collect()}
    assert [got[k].mask for k in range(5)] == [2, 10, 10, 10, 8] and {got[k].kind for k in range(5)} == {"rowhouse"}
    assert (got[9].kind, got[9].mask, got[9].size) == ("rowhouse_like", 0, 1)
    assert len({got[k].seed for k in range(5)}) == 1 and got[9].seed != got[0].seed
    again = {r.id: r.seed for r in context.contexts(houses.orderBy(F.desc("id")), "id", 32.0).collect()}
    assert again == {k: r.seed for k, r in got.items()}


def test_seeds_by_hand(spark):
    """The mixing of whole numbers, in plain arithmetic."""
    def mixed(seed, value):
        x = seed ^ (value + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x ^= x >> 27
        return (x * 0x94D049BB133111EB & (1 << 64) - 1) ^ x >> 31

    values = [3, 18446744073709551615, 77, 40]
    want = 0x510E527FADE682D1
    for v in values:
        want = mixed(want, v)
    got = spark.createDataFrame([([3, -1, 77, 40],)], "v array<long>").select(context.seed_of("v")).first()[0]
    assert got % (1 << 64) == want
    both = 0x6A09E667F3BCC909
    for v in sorted([want, 5]):
        both = mixed(both, v)
    assert spark.createDataFrame([([got, 5],), ([5, got],)], "v array<long>").select(context.group_seed("v")).distinct().first()[0] % (1 << 64) == both


def test_turned_party_edges(spark):
    """Two houses side by side, turned by 30 degrees, still share a wall."""
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    turn = lambda pts: [(x * c - y * s, x * s + y * c) for x, y in pts]
    rows = [(k, 9.0, turn([(5.0 * k, 0.0), (5.0 * k + 5, 0.0), (5.0 * k + 5, 16.0), (5.0 * k, 16.0)])) for k in range(2)]
    frame = spark.createDataFrame(rows, "id long, height double, ring array<struct<x:double,y:double>>")
    got = {r.id: (r.mask, r.kind) for r in context.contexts(frame, "id", 32.0).collect()}
    assert got == {0: (2, "twin"), 1: (8, "twin")}


def test_earth_centred_round_trip(spark):
    frame = spark.createDataFrame([(-75.16, 39.95, 12.0), (0.0, 0.0, 0.0), (120.0, -89.0, 3000.0)], "lon double, lat double, h double")
    x, y, z = geometry.earth_centred(*map(F.col, ("lon", "lat", "h")))
    back = frame.withColumns({"x": x, "y": y, "z": z}).select("*", *[v.alias(n) for n, v in zip(("a", "b", "c"), geometry.from_earth_centred(*map(F.col, ("x", "y", "z"))))])
    for r in back.collect():
        assert (r.a, r.b, r.c) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9), pytest.approx(r.h, abs=1e-5))
    assert back.where("lat = 0").first().x == 6_378_137.0


def test_lengths_and_addresses(spark):
    values = spark.createDataFrame([("12 m",), ("100 ft",), ("10'",), ("12 yards",), ("-2 m",), (None,)], "v string")
    got = [r[0] for r in values.select(F.round(text.parse_length(F.col("v")), 3)).collect()]
    assert got == [12.0, 30.48, 3.048, None, None, None]
    said = spark.createDataFrame([("1200-1204 N. Broad Street #3",), ("12-13 Market St",), ("Market St",), (None,)], "v string")
    assert [r.a and tuple(r.a) for r in said.select(text.address(F.col("v")).alias("a")).collect()] == [(1200, 1204, "N BROAD ST"), None, None, None]
    more = ["1200 \u2013 1204 Market St", "0120 Market St", "1234567 Market St", "12-14Market St", "12 - Market St", "1204-1200 Market St", " 7  Spruce  Lane ", "7", "", "7 Nowhere"]
    got = [r.a and tuple(r.a) for r in spark.createDataFrame([(m,) for m in more], "v string").select(text.address(F.col("v")).alias("a")).collect()]
    assert got == [(1200, 1204, "MARKET ST"), None, None, None, (12, 12, "- MARKET ST"), None, (7, 7, "SPRUCE LN"), None, None, None]


def test_flood_fill_and_labels(spark):
    ring = [(0, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    cells = spark.createDataFrame(ring + [(1, 0, 0)], "tile long, row int, col int")
    got = raster.outside_fill(cells, ["tile"], 4, 4).groupBy("tile").count().collect()
    assert {r.tile: r["count"] for r in got} == {0: 9, 1: 1}
    labels = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 2.0, 2.0), (1, "b", 1, 1.0, 1.0, 3.0, 3.0), (1, "a", 2, 9.0, 9.0, 10.0, 10.0), (1, "c", 3, 5.0, 5.0, 6.0, 6.0)], "view long, name string, rank long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.name, r.place) for r in raster.place_labels(labels, "view").orderBy("place").collect()] == [("a", 1), ("c", 2)]


def test_contracts_fail_closed(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None)], "k long, v string")
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.unique_key(frame, "unique", "k"))
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.where_not(frame, "known", F.col("v") != "", "k"))
    with pytest.raises(contracts.ContractError):
        contracts.exact_schema(frame, T.StructType().add("v", "string").add("k", "long"))
    contracts.enforce(contracts.unique_key(frame.limit(1), "unique", "k"))
