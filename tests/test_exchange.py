"""Raster artifacts and the exchange of pairs, with damage and kills at every step."""

import glob

import pytest
from pyspark.sql import functions as F

from gridloom.operators.contracts import ContractError
from gridloom.sources import pair, publish, rasters

MASK = rasters.Grid(width=7, height=150)
TERRAIN = rasters.Grid(width=5, height=70, digits=4, lowest=-32768, empty=-32768, rows=16)


@pytest.mark.parametrize("grid", [MASK, TERRAIN])
def test_raster_round_trip(spark, tmp_path, grid):
    value = F.expr("cast(id * 7 % 16 as long)") if grid.digits == 1 else F.expr("cast(id * 977 % 65536 - 32768 as long)")
    cells = spark.range(0, grid.width * grid.height, 3).select((F.col("id") % grid.height).alias("row"), F.floor(F.col("id") / grid.height).alias("col"), value.alias("value"))
    root = str(tmp_path / "raster")
    header = rasters.write(cells, grid, root, {"source": "test"})
    got, said = rasters.open_raster(spark, root, grid)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in cells.collect() if r.value != grid.empty)
    assert said["sha256"] == header["sha256"] and header["blocks"] == -(-grid.height // grid.rows) and said["about"] == {"source": "test"}
    places = spark.createDataFrame([(0.5, 0.5), (99.0, 0.5)], "x double, y double")
    found = {r.x: r.value for r in rasters.at_cells(places, got, F.col("x"), F.col("y"), 1.0).collect()}
    assert found[99.0] is None
    with pytest.raises(ContractError, match="not Grid"):
        rasters.open_raster(spark, root, rasters.Grid(width=8, height=150))


def test_a_flipped_byte_names_its_block(spark, tmp_path):
    root = str(tmp_path / "raster")
    cells = spark.range(700).selectExpr("id % 140 as row", "id div 140 as col", "id % 15 + 1 as value")
    rasters.write(cells, MASK, root)
    said = publish.current_header(spark, root)
    blocks = spark.read.parquet(f"{root}/{said['generation']}")
    flipped = F.when(F.col("block") == 1, F.unhex(F.concat(F.lit("FF"), F.substring(F.hex("payload"), 3, 1 << 20)))).otherwise(F.col("payload"))
    for damaged, said_of in ((blocks.withColumn("payload", flipped), r"blocks \[1\]"), (blocks.where("block <> 2"), "missing"), (blocks.withColumn("block", F.col("block") % 2), "exchanged")):
        damaged.write.mode("overwrite").parquet(f"{root}/generation-damaged")
        publish.make_current(spark, root, "generation-damaged", said)
        with pytest.raises(ContractError, match=said_of):
            rasters.open_raster(spark, root)


def test_bad_cells(spark, tmp_path):
    for rows, said in (([(0, 0, 16)], "outside"), ([(150, 0, 1)], "outside"), ([(0, 7, 1)], "outside"), ([(3, 3, 1), (3, 3, 2)], "twice")):
        with pytest.raises(Exception, match=said):
            rasters.write(spark.createDataFrame(rows, "row long, col long, value long"), MASK, str(tmp_path / "bad"))
    assert not glob.glob(f"{tmp_path}/bad/CURRENT.json")
    header = rasters.write(spark.createDataFrame([], "row long, col long, value long"), MASK, str(tmp_path / "none"))
    assert rasters.open_raster(spark, str(tmp_path / "none"))[0].collect() == [] and header["blocks"] == 3


class Killed(BaseException):
    pass


STEPS = 10


@pytest.mark.parametrize("had", [False, True])
def test_kills_at_every_step(spark, tmp_path, monkeypatch, had):
    old, new = spark.range(3), spark.range(100, 105)
    outcomes = set()
    for stop in range(STEPS):
        root = str(tmp_path / f"pair{stop}")
        if had:
            pair.exchange(old, root, {"v": 1})
        count = iter(range(100))

        def step(real, *args):
            if next(count) == stop:
                raise Killed
            return real(*args)

        with monkeypatch.context() as m:
            for name in ("move", "delete", "write"):
                real = getattr(pair._Files, name)
                m.setattr(pair._Files, name, lambda self, *args, real=real: step(real, self, *args))
            try:
                pair.exchange(new, root, {"v": 2})
                killed = False
            except Killed:
                killed = True
        if glob.glob(f"{root}/INTENT.json") or glob.glob(f"{root}/*.before"):
            with pytest.raises(pair.PairError):
                pair.read(spark, root)
        outcomes.add(pair.recover(spark, root))
        if not had and not glob.glob(f"{root}/{pair.ROWS}"):
            assert killed and not glob.glob(f"{root}/{pair.ABOUT}")
            continue
        rows, about = pair.read(spark, root)
        ids = sorted(r.id for r in rows.collect())
        assert (ids, about) in ((([0, 1, 2]), {"v": 1}), ([100, 101, 102, 103, 104], {"v": 2}))
        assert killed or about == {"v": 2}
    assert {"clean", "finished", "rolled back"} <= outcomes


def test_half_a_pair_is_refused(spark, tmp_path):
    root = str(tmp_path / "pair")
    pair.exchange(spark.range(3), root, {})
    spark.range(4).write.mode("overwrite").parquet(f"{root}/{pair.ROWS}")
    with pytest.raises(pair.PairError, match="do not fit"):
        pair.read(spark, root)
    spark.range(4).write.parquet(f"{root}/rows.before")
    with pytest.raises(pair.PairError, match="without an intent"):
        pair.exchange(spark.range(3), root, {})
