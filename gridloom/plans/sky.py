"""The sun over the city, and the light it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import solar
from ..sources import layers as L


def sun_and_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitude and azimuth of the sun at each event, and the phase and strength of the light."""
    altitude, azimuth = solar.position(F.col("ts"), F.lit(-75.16), F.lit(39.95))
    seen = L.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", altitude.alias("altitude"), azimuth.alias("azimuth"))
    phase, cover = solar.lighting(F.col("altitude"))
    return seen.select("event_id", F.round("altitude", 4).alias("altitude"), F.round("azimuth", 4).alias("azimuth"), phase.alias("phase"), F.round(cover, 4).alias("cover"))


# the same series, with the azimuth from the cosine rule and the side of the meridian
SUN_AND_LIGHT = """WITH d AS (SELECT event_id, epoch_us(ts)/86400000000.0::DOUBLE-10957.5 AS n FROM events),
    e AS (SELECT event_id, n, radians(357.528+0.9856003*n) AS g, radians(23.439-0.0000004*n) AS e FROM d), l AS (SELECT *, radians(280.460+0.9856474*n+1.915*sin(g)+0.020*sin(2*g)) AS l FROM e),
    r AS (SELECT event_id, asin(sin(e)*sin(l)) AS dec, radians(280.46061837+360.98564736629*n-75.16)-atan2(cos(e)*sin(l), cos(l)) AS h, radians(39.95) AS p FROM l),
    a AS (SELECT *, asin(sin(p)*sin(dec)+cos(p)*cos(dec)*cos(h)) AS alt FROM r),
    z AS (SELECT *, degrees(acos(greatest(-1, least(1, (sin(dec)-sin(alt)*sin(p))/(cos(alt)*cos(p)))))) AS az FROM a), w AS (SELECT event_id, degrees(alt) AS alt, CASE WHEN sin(h)>0 THEN 360-az ELSE az END AS az FROM z)
    SELECT event_id, round(alt, 4) AS altitude, round(az, 4) AS azimuth, CASE WHEN alt>=10 THEN 'day' WHEN alt>=0 THEN 'golden' WHEN alt>=-6 THEN 'twilight' ELSE 'night' END AS phase,
        round(CASE WHEN alt>=10 THEN 0 WHEN alt>=0 THEN (10-alt)/100 WHEN alt>=-6 THEN 0.12-alt/6*0.16 ELSE 0.42 END, 4) AS cover FROM w"""

QUERIES = {"sun_and_light": (sun_and_light, SUN_AND_LIGHT)}
