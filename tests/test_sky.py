"""The sun at places and times where its position is known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions import solar


@pytest.mark.parametrize("at, lon, lat, altitude, azimuth", [
    ("2024-03-20 12:07:25", 0.0, 0.0, 90.0, None),  # equinox, the equation of time is seven and a half minutes
    ("2024-06-20 20:51:00", -132.3, 23.436, 90.0, None),  # solstice on the tropic
    ("2024-06-21 17:02:40", -75.16, 39.95, 90 - 39.95 + 23.436, 180.0),  # noon in the city
    ("2024-12-21 16:58:50", -75.16, 39.95, 90 - 39.95 - 23.436, 180.0),
    ("2024-12-21 00:00:00", 0.0, 90.0, -23.436, None),  # the pole in winter
    ("2003-10-17 19:30:30", -105.1786, 39.743, 39.888, 194.34),  # the worked example of a published algorithm, refraction left out
])
def test_known_positions(spark, at, lon, lat, altitude, azimuth):
    row = spark.createDataFrame([(dt.datetime.fromisoformat(at).replace(tzinfo=dt.timezone.utc),)], "t timestamp")
    a, z = solar.position(F.col("t"), F.lit(lon), F.lit(lat))
    got = row.select(a.alias("a"), z.alias("z")).first()
    assert got.a == pytest.approx(altitude, abs=0.35 if azimuth is None else 0.03)
    assert azimuth is None or got.z == pytest.approx(azimuth, abs=0.2)


def test_phases(spark):
    rows = spark.createDataFrame([(a,) for a in (45.0, 10.0, 9.99, 0.0, -0.01, -6.0, -6.01, None)], "a double")
    phase, cover = solar.lighting(F.col("a"))
    got = rows.select(phase.alias("p"), cover.alias("c")).collect()
    assert [r.p for r in got] == ["day", "day", "golden", "golden", "twilight", "twilight", "night", None]
    assert [None if r.c is None else round(r.c, 3) for r in got] == [0, 0, 0, 0.1, 0.12, 0.28, 0.42, None]
