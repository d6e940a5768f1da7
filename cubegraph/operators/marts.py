"""Roll-ups over the star schema.

Every roll-up reduces the fact by its integer keys first and joins dimension
attributes to the reduced rows, so a hot unit or day shrinks in the map tasks and
the wide joins see keys, not readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.numbers import pct
from cubegraph.operators import rollup
from cubegraph.operators.ordering import top

# Daily extremes that count as a hot and as a cold day.
HOT = 28
COLD = 10


def _mean(total: str, count: str) -> Column:
    """Mean from a carried sum and count; null where nothing was counted."""
    return F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0))


def climate_by_bimester(
    fact_climate: DataFrame, dim_time: DataFrame, hot: float = HOT, cold: float = COLD
) -> DataFrame:
    """Mean of daily means (two places), hot and cold days, rain, per bimester."""
    return (
        fact_climate.join(dim_time.select("id_tiempo", "anio", "bimestre"), "id_tiempo")
        .groupBy("anio", "bimestre")
        .agg(
            F.round(F.avg("temp_promedio"), 2).alias("temp_promedio"),
            F.count_if(F.col("temp_maxima") >= hot).alias("dias_ola_calor"),
            F.count_if(F.col("temp_minima") <= cold).alias("dias_frio"),
            F.sum("lluvia_total").alias("total_lluvia"),
        )
    )


def water_by_bimester(fact: DataFrame, dim_time: DataFrame) -> DataFrame:
    daily = fact.groupBy("id_tiempo").agg(F.sum("consumo_total").alias("total_agua"))
    return (
        daily.join(dim_time.select("id_tiempo", "anio", "bimestre"), "id_tiempo")
        .groupBy("anio", "bimestre")
        .agg(F.sum("total_agua").alias("total_agua"))
    )


def correlate(water: DataFrame, climate: DataFrame) -> DataFrame:
    return water.join(climate, ["anio", "bimestre"])


def correlation(
    fact: DataFrame,
    fact_climate: DataFrame,
    dim_time: DataFrame,
    hot: float = HOT,
    cold: float = COLD,
    rounded: bool = False,
) -> DataFrame:
    """Consumption against climate per bimester; both facts reduce before they meet."""
    table = correlate(
        water_by_bimester(fact, dim_time), climate_by_bimester(fact_climate, dim_time, hot, cold)
    )
    if rounded:
        table = table.withColumns(
            {c: F.round(c, 2) for c in ("total_agua", "total_lluvia")}
        )
    return table.orderBy("anio", "bimestre")


def by_borough(units: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Readings, total, mean, non-domestic total and share per borough, largest first; from state by unit."""
    return (
        rollup.added(units.join(dim_location.select("id_ubicacion", "alcaldia"), "id_ubicacion"), ["alcaldia"])
        .select(
            "alcaldia",
            "registros",
            F.col("suma_consumo_total").alias("total"),
            rollup.mean("consumo_prom").alias("promedio"),
            F.col("suma_consumo_total_no_dom").alias("no_dom"),
            pct(F.col("suma_consumo_total_no_dom"), F.col("suma_consumo_total")).alias("pct_no_dom"),
        )
        .orderBy(F.desc_nulls_last("total"), "alcaldia")
    )


def by_neighbourhood_bimester(periods: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Total and mean per unit and bimester, by name; from state by unit and bimester."""
    return (
        periods.join(dim_location.select("id_ubicacion", "alcaldia", "colonia"), "id_ubicacion")
        .select(
            "alcaldia", "colonia", "anio", "bimestre",
            F.col("suma_consumo_total").alias("total"), rollup.mean("consumo_prom").alias("promedio"),
        )
        .orderBy(*[F.asc_nulls_last(c) for c in ("alcaldia", "colonia", "anio", "bimestre")])
    )


def top_neighbourhoods(units: DataFrame, dim_location: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest units, from state by unit; only those rows meet the dimension. Ties go to the smaller key."""
    totals = units.groupBy("id_ubicacion").agg(F.sum("suma_consumo_total").alias("total"))
    best = top(totals, [F.desc_nulls_last("total"), "id_ubicacion"], n)
    labels = dim_location.select("id_ubicacion", "alcaldia", "colonia")
    return (
        labels.join(best, "id_ubicacion")
        .orderBy(F.desc_nulls_last("total"), "id_ubicacion")
        .select("alcaldia", "colonia", "total")
    )


_SUMS = ("consumo_total", "consumo_total_dom", "consumo_total_mixto", "consumo_total_no_dom")
_MEANS = ("consumo_prom", "consumo_prom_dom", "consumo_prom_mixto", "consumo_prom_no_dom")

# Columns of a mart row.
MART_COLUMNS = [
    "anio",
    "bimestre",
    "fecha",
    "alcaldia",
    "colonia",
    "latitud",
    "longitud",
    "indice_des",
    "consumo_total",
    "consumo_prom",
    "consumo_total_dom",
    "consumo_prom_dom",
    "consumo_total_mixto",
    "consumo_prom_mixto",
    "consumo_total_no_dom",
    "consumo_prom_no_dom",
]


def build_mart(
    fact: DataFrame, dim_time: DataFrame, dim_location: DataFrame, dim_level: DataFrame
) -> DataFrame:
    """Four sums and four means per day, unit and level, with their attributes.

    Grouping by the keys equals grouping by the attributes, because each key
    stands for one combination of them. Unsorted: the export sorts.
    """
    keys = ["id_ubicacion", "id_tiempo", "id_indice_des"]
    reduced = fact.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[(F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))).alias(c) for c in _MEANS],
    )
    return (
        reduced.join(dim_time.select("id_tiempo", "anio", "bimestre", "fecha"), "id_tiempo")
        .join(dim_level, "id_indice_des")
        .join(dim_location, "id_ubicacion")
        .select(*MART_COLUMNS)
    )


def mart_order() -> list[Column]:
    """Export order, made unique by day and level."""
    return [
        F.asc_nulls_last(c)
        for c in ("anio", "bimestre", "alcaldia", "colonia", "fecha", "indice_des")
    ]


def aggregate_observations(fact: DataFrame, dim_level: DataFrame) -> DataFrame:
    """Observations at (unit, day, level) grain with their source row count."""
    return (
        fact.groupBy("id_ubicacion", "id_tiempo", "id_indice_des")
        .agg(
            F.sum("consumo_total").alias("consumo_total"),
            (F.sum("consumo_prom").cast("double") / F.nullif(F.count("consumo_prom"), F.lit(0))).alias(
                "consumo_prom"
            ),
            F.sum("consumo_total_dom").alias("consumo_total_dom"),
            F.sum("consumo_total_no_dom").alias("consumo_total_no_dom"),
            F.sum("consumo_total_mixto").alias("consumo_total_mixto"),
            F.count("*").alias("registros"),
        )
        .join(dim_level, "id_indice_des")
    )


#: Columns of a retrieved page, in the order they are shown.
PAGE_COLUMNS = ["anio", "bimestre", "fecha", "alcaldia", "colonia", "indice_des", "consumo_total", "consumo_prom"]


def retrieval_rows(fact: DataFrame, dim_time: DataFrame, dim_location: DataFrame, dim_level: DataFrame) -> DataFrame:
    """The rows that are paged through, with the names they are shown and ordered by."""
    return (
        fact.select("id_tiempo", "id_ubicacion", "id_indice_des", "consumo_total", "consumo_prom")
        .join(dim_time.select("id_tiempo", "anio", "bimestre", "fecha"), "id_tiempo")
        .join(dim_level, "id_indice_des")
        .join(dim_location.select("id_ubicacion", "alcaldia", "colonia"), "id_ubicacion")
        .select(*PAGE_COLUMNS)
    )


def retrieval_order() -> list[Column]:
    """By period, borough and neighbourhood, then by all that is shown; so it holds whatever order keys were given in."""
    shown = ("anio", "bimestre", "alcaldia", "colonia", "fecha", "indice_des", "consumo_total", "consumo_prom")
    return [F.asc_nulls_last(c) for c in shown]
