"""Coordinate expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


# The area's box (inclusive), kilometres per degree, radius.
AREA = Box(19.04, 19.60, -99.36, -98.94)
KM_PER_DEGREE = 111.32
RADIUS_KM = 1.5


def in_bbox(lat: Column, lon: Column, box: Box = AREA) -> Column:
    return lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)


def distance_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Planar distance seen from ``a``: directed, as the longitude is scaled at lat_a.

    Differences are taken before the cast to double, so decimal inputs give
    exact ties for mirrored points.
    """
    dy = (lat_a - lat_b).cast("double")
    dx = (lon_a - lon_b).cast("double") * F.cos(F.radians(lat_a.cast("double")))
    return F.lit(KM_PER_DEGREE) * F.sqrt(dy * dy + dx * dx)


def micro(degrees: Column) -> Column:
    """Six-place degrees as a whole number, which subtracts exactly and fast."""
    return (degrees.cast("decimal(9,6)") * F.lit(1_000_000)).cast("long")


def scale_at(lat: Column) -> Column:
    return F.cos(F.radians(lat.cast("double")))


def micro_distance_km(y_a: Column, x_a: Column, scale_a: Column, y_b: Column, x_b: Column) -> Column:
    """:func:`distance_km` over whole micro-degrees and the origin's longitude scale."""
    dy = (y_a - y_b).cast("double") / F.lit(1_000_000.0)
    dx = (x_a - x_b).cast("double") / F.lit(1_000_000.0) * scale_a
    return F.lit(KM_PER_DEGREE) * F.sqrt(dy * dy + dx * dx)


def wkt_point(lon: Column, lat: Column) -> Column:
    """``POINT(lon lat)``, null where a coordinate is null."""
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
