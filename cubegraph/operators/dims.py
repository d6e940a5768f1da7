"""Dimensions of the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions import dates, geo
from cubegraph.operators.ordering import with_surrogate_key
from cubegraph.operators.relational import require_present


def distinct_dim(df: DataFrame, columns: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """Distinct members, optionally only those with the named columns present."""
    members = require_present(df, *not_null) if not_null else df
    return members.select(*columns).distinct()


def calendar_days(climate: DataFrame) -> DataFrame:
    """One row per day of the climate series, with year, month, day and bimester."""
    day = dates.day_of(F.col("fecha_hora"))
    days = climate.select(day.alias("fecha")).distinct()
    return days.select(
        "fecha",
        dates.year_of(F.col("fecha")).alias("anio"),
        dates.month_of(F.col("fecha")).alias("mes"),
        dates.day_no(F.col("fecha")).alias("dia"),
        dates.bimester(dates.month_of(F.col("fecha"))).alias("bimestre"),
    )


def build_dim_time(climate: DataFrame) -> DataFrame:
    return with_surrogate_key(calendar_days(climate), ["fecha"], "id_tiempo")


def build_dim_location(readings: DataFrame) -> DataFrame:
    units = distinct_dim(readings, ["alcaldia", "colonia"], not_null=["colonia"])
    return with_surrogate_key(units, ["alcaldia", "colonia"], "id_ubicacion")


def build_dim_level(readings: DataFrame) -> DataFrame:
    levels = distinct_dim(readings, ["indice_des"], not_null=["indice_des"])
    return with_surrogate_key(levels, ["indice_des"], "id_indice_des")


def centroids(readings: DataFrame, box: geo.Box = geo.AREA) -> DataFrame:
    """Mean in-box coordinate per unit, rounded half away from zero at six places.

    Coordinates are summed as decimals, so the mean does not depend on the order
    in which partitions arrive.
    """
    lat, lon = F.col("latitud"), F.col("longitud")
    return (
        readings.filter(geo.in_bbox(lat, lon, box))
        .groupBy("alcaldia", "colonia")
        .agg(
            F.round(F.avg(lat.cast("decimal(9,6)")), 6).cast("decimal(9,6)").alias("latitud"),
            F.round(F.avg(lon.cast("decimal(9,6)")), 6).cast("decimal(9,6)").alias("longitud"),
        )
    )


def members(readings: DataFrame, box: geo.Box = geo.AREA) -> DataFrame:
    """One pass over the readings: (borough, neighbourhood, level) with how many coordinates lie in the box, and their sums.

    Units, levels and centroids all come from these rows, and rows of later readings add to them.
    """
    lat, lon = F.col("latitud"), F.col("longitud")
    inside = geo.in_bbox(lat, lon, box)
    return readings.groupBy("alcaldia", "colonia", "indice_des").agg(
        F.count_if(inside).alias("n"),
        F.sum(F.when(inside, lat.cast("decimal(9,6)"))).alias("latitud"),
        F.sum(F.when(inside, lon.cast("decimal(9,6)"))).alias("longitud"),
    )


def centroids_of(state: DataFrame) -> DataFrame:
    """The centroids that :func:`centroids` finds, from the rows of :func:`members`."""
    sums = state.groupBy("alcaldia", "colonia").agg(*[F.sum(c).alias(c) for c in ("n", "latitud", "longitud")])

    def point(column: str) -> Column:
        return F.round(F.col(column) / F.col("n"), 6).cast("decimal(9,6)").alias(column)

    return sums.filter("n > 0").select("alcaldia", "colonia", point("latitud"), point("longitud"))


def attach_centroids(dim: DataFrame, points: DataFrame) -> DataFrame:
    """Give every unit its centroid; units without readings in the box keep nulls."""
    plain = dim.drop("latitud", "longitud")
    return plain.join(points, ["alcaldia", "colonia"], "left").select(
        *plain.columns, "latitud", "longitud"
    )


def geometry_view(dim: DataFrame) -> DataFrame:
    """Units with a coordinate, with their point as text."""
    return require_present(dim, "latitud", "longitud").select(
        "id_ubicacion",
        "alcaldia",
        "colonia",
        "latitud",
        "longitud",
        geo.wkt_point(F.col("longitud"), F.col("latitud")).alias("wkt"),
    )
