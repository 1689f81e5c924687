"""The packed world: round trip, the file's bytes, older versions, damaged and invalid input."""

import glob
import json
import struct

import pytest

from gridloom.sources import world as W

RING = [(0.0, 0.0), (5.0, 0.0), (5.0, 16.0), (0.0, 16.0)]


def ring_bytes(points):
    return struct.pack("<I", len(points)) + b"".join(struct.pack("<ff", *p) for p in points)


def layers(spark, n=40):
    made = {
        "buildings": [(k, 9.5 + k, RING, k % 4 if k % 3 else None) for k in range(n)],
        "parts": [(k, 2**40 + k, 20.0, 3.0, 2.5, k % 6, RING) for k in range(7)],
        "meshes": [(k, k, 12.0, RING, [[(1.0, 2.0, 3.0, 0.5, 0.25)] * 3] * (k + 1)) for k in range(3)],
        "city": [(0, RING)],
        "parks": [(1, RING[:3]), (0, RING)],
        "trees": [(k, 1.0 * k, 2.0, 0.25, k % 3) for k in range(n)],
        "transport": [(0, 2, RING[:2]), (1, 1, RING)],
    }
    return {k: spark.createDataFrame(v, f"ord long, {W.LAYERS[k]}") for k, v in made.items()}


def read(spark, path, layer):
    spark.dataSource.register(W.PackedWorld)
    return sorted(spark.read.format("packed_world").option("layer", layer).load(path).collect(), key=lambda r: r.ord)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "world")
    W.write_world(layers(spark), path, (0.0, 0.0, 100.0, 200.0), bytes(range(32)), slices=5)
    return path


def test_round_trip(spark, folder):
    for layer, df in layers(spark).items():
        assert read(spark, folder, layer) == sorted(df.collect(), key=lambda r: r.ord)
    assert read(spark, folder, "water") == []
    assert len(glob.glob(f"{folder}/slice-*.bin")) >= 4


def test_bytes_of_the_file(spark, folder, tmp_path):
    target = str(tmp_path / "world.bin")
    W.export_file(spark, folder, target)
    want = b"GEOPHILY" + struct.pack("<10I", 12, 32129, 40, 7, 3, 1, 0, 2, 40, 2) + bytes(range(32)) + struct.pack("<4d", 0, 0, 100, 200)
    want += b"".join(struct.pack("<f", 9.5 + k) + ring_bytes(RING) + bytes([k % 4 if k % 3 else 255]) for k in range(40))
    want += b"".join(struct.pack("<QfffB", 2**40 + k, 20, 3, 2.5, k % 6) + ring_bytes(RING) for k in range(7))
    want += b"".join(struct.pack("<IfI", k, 12, k + 1) + ring_bytes(RING) + struct.pack("<5f", 1, 2, 3, 0.5, 0.25) * 3 * (k + 1) for k in range(3))
    want += ring_bytes(RING) + ring_bytes(RING) + ring_bytes(RING[:3])
    want += b"".join(struct.pack("<fffB", k, 2, 0.25, k % 3) for k in range(40))
    want += b"\x02" + ring_bytes(RING[:2]) + b"\x01" + ring_bytes(RING)
    assert open(target, "rb").read() == want
    said = json.load(open(f"{folder}/manifest.json"))
    assert said["size"] == len(want) and want[said["offsets"]["transport"] :][0] == 2
    assert [r.form for r in read(spark, target, "trees")] == [k % 3 for k in range(40)]
    for cut in (7, 60, 500, len(want) - 1):
        open(target, "wb").write(want[:cut])
        with pytest.raises(Exception, match="not a packed world|cut off|more items"):
            read(spark, target, "transport")
    open(target, "wb").write(want + b"x")
    with pytest.raises(Exception, match="bytes follow"):
        read(spark, target, "trees")


def test_older_versions(spark, tmp_path):
    path = str(tmp_path / "old.bin")
    body = bytes(32) + struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<f", 8) + ring_bytes(RING) + struct.pack("<fff", 1, 2, 0.5)
    open(path, "wb").write(b"GEOPHILY" + struct.pack("<9I", 9, 32129, 1, 0, 0, 0, 0, 0, 1) + body)
    assert [(r.height, r.frontage) for r in read(spark, path, "buildings")] == [(8.0, None)] and read(spark, path, "trees")[0].form == 0
    open(path, "wb").write(b"GEOPHILY" + struct.pack("<9I", 8, 32129, 1, 0, 0, 0, 0, 0, 1) + body)
    with pytest.raises(Exception, match="version 8"):
        read(spark, path, "buildings")
    open(path, "wb").write(b"GEOPHILY" + struct.pack("<9I", 9, 4326, 1, 0, 0, 0, 0, 0, 1) + body)
    with pytest.raises(Exception, match="coordinate system"):
        read(spark, path, "buildings")


def test_damage_is_found(spark, folder):
    one = sorted(glob.glob(f"{folder}/slice-*.bin"))[0]
    data = bytearray(open(one, "rb").read())
    data[9] ^= 1
    open(one, "wb").write(data)
    with pytest.raises(Exception, match="changed or cut off"):
        read(spark, folder, "buildings")
    open(one, "wb").write(data[:-3])
    with pytest.raises(Exception, match="changed or cut off"):
        read(spark, folder, "buildings")


@pytest.mark.parametrize("layer, row, said", [
    ("buildings", (0, 9.0, RING, 4), "no edge"), ("buildings", (0, float("nan"), RING[:2], None), "3 points"), ("parts", (0, 1, 5.0, 6.0, 0.0, 1, RING), "out of range"),
    ("trees", (0, 1.0, 1.0, 9.0, 1), "diameter"), ("transport", (0, 1, RING[:1]), "points"), ("meshes", (0, 1, 9.0, RING, []), "triangles"), ("city", (0, [(float("inf"), 1.0)] * 3), "finite"),
])
def test_invalid_rows_leave_no_world(spark, tmp_path, layer, row, said):
    path = tmp_path / "bad"
    with pytest.raises(Exception, match=said):
        W.write_world({layer: spark.createDataFrame([row], f"ord long, {W.LAYERS[layer]}")}, str(path), (0, 0, 1, 1))
    assert not (path / "manifest.json").exists()
