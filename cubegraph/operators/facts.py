"""Fact tables of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions import dates

# Measure columns in load order.
MEASURES = [
    "consumo_total_mixto",
    "consumo_prom_dom",
    "consumo_total_dom",
    "consumo_prom_mixto",
    "consumo_total",
    "consumo_prom",
    "consumo_prom_no_dom",
    "consumo_total_no_dom",
]


def build_fact_consumption(
    readings: DataFrame, dim_time: DataFrame, dim_location: DataFrame, dim_level: DataFrame
) -> DataFrame:
    """Readings with a day, a unit and a level; the inner joins are the cleaning.

    The selective joins on the small dimensions come first, so fewer readings
    reach the exchange on the unit name. No side is hinted: measured sizes
    decide on broadcasts, and a hot unit is split by the skew-join rule.
    """
    days = dim_time.select("id_tiempo", F.col("fecha").alias("fecha_referencia"))
    units = dim_location.select("id_ubicacion", "alcaldia", "colonia")
    return (
        readings.join(days, "fecha_referencia")
        .join(dim_level, "indice_des")
        .join(units, ["alcaldia", "colonia"])
        .select("id_tiempo", "id_ubicacion", "id_indice_des", *MEASURES)
    )


def stable_mean(column: str) -> Column:
    """The mean from a decimal sum, divided once, so the order of addition cannot show; where a value is no such decimal, the plain mean."""
    exact = F.col(column).try_cast("decimal(30,15)")
    return F.when(F.count(exact) == F.count(column), F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))).otherwise(F.avg(column))


def daily_rollup(climate: DataFrame) -> DataFrame:
    """Sub-daily series to days: extremes and means of temperature, mean humidity, rain."""
    return climate.groupBy(dates.day_of(F.col("fecha_hora")).alias("fecha")).agg(
        F.max("temperatura").alias("temp_maxima"),
        F.min("temperatura").alias("temp_minima"),
        stable_mean("temperatura").alias("temp_promedio"),
        F.avg("humedad_relativa").alias("humedad_promedio"),
        F.sum("lluvia").alias("lluvia_total"),
    )


def build_fact_climate(climate: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Daily climate keyed by day; rolled up before the join, so a day joins once."""
    return (
        daily_rollup(climate)
        .join(dim_time.select("id_tiempo", "fecha"), "fecha")
        .drop("fecha")
        .select(
            "id_tiempo",
            "temp_maxima",
            "temp_minima",
            "temp_promedio",
            "humedad_promedio",
            "lluvia_total",
        )
    )


def star(fact: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    """Fact joined to ``(dimension, key)`` pairs."""
    out = fact
    for dim, key in dims:
        out = out.join(dim, key)
    return out
