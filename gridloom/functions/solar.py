"""The sun's place in the sky as column expressions, by the Astronomical Almanac's low-precision series (within 0.01 degrees from
1950 to 2050): ecliptic longitude, right ascension and declination, and the hour angle from Greenwich sidereal time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The series' coefficients in degrees and days since noon of 1 January 2000, and the lighting phases.
MEAN_LONGITUDE, MEAN_ANOMALY = (280.460, 0.9856474), (357.528, 0.9856003)
EQUATION = (1.915, 0.020)
OBLIQUITY = (23.439, -0.0000004)
SIDEREAL = (280.46061837, 360.98564736629)
EPOCH_DAYS = 10_957.5
DAY_FROM, GOLDEN_FROM, TWILIGHT_FROM = 10.0, 0.0, -6.0


def position(at: Column, longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Altitude above the horizon and azimuth from north through east, in degrees, without refraction. Times without a
    zone are taken in the session's."""
    days = F.unix_micros(at.cast("timestamp")) / 86_400_000_000.0 - EPOCH_DAYS
    linear = lambda c: days * c[1] + c[0]
    anomaly = F.radians(linear(MEAN_ANOMALY))
    ecliptic = F.radians(linear(MEAN_LONGITUDE) + F.sin(anomaly) * EQUATION[0] + F.sin(anomaly * 2) * EQUATION[1])
    tilt = F.radians(linear(OBLIQUITY))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sine = F.sin(tilt) * F.sin(ecliptic)  # of the declination
    cosine = F.sqrt(1 - sine * sine)
    hour = F.radians(linear(SIDEREAL) + longitude) - ascension
    phi = F.radians(latitude)
    up = F.sin(phi) * sine + F.cos(phi) * cosine * F.cos(hour)
    north = F.cos(phi) * sine - F.sin(phi) * cosine * F.cos(hour)
    east = -cosine * F.sin(hour)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def lighting(altitude: Column) -> tuple[Column, Column]:
    """The phase of day, and how strongly its tint covers the map."""
    phase = F.when(altitude >= DAY_FROM, "day").when(altitude >= GOLDEN_FROM, "golden").when(altitude >= TWILIGHT_FROM, "twilight").when(altitude.isNotNull(), "night")
    cover = F.when(altitude >= DAY_FROM, 0.0).when(altitude >= GOLDEN_FROM, (DAY_FROM - altitude) / 100).when(altitude >= TWILIGHT_FROM, altitude / TWILIGHT_FROM * 0.16 + 0.12).when(altitude.isNotNull(), 0.42)
    return phase, cover
