"""The warehouse load: staging to dimensions and facts, in dependency order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cubegraph.functions.geo import AREA, Box
from cubegraph.operators import dims, facts
from cubegraph.operators.ordering import with_serial, with_surrogate_key
from cubegraph.operators.quality import require_coordinates, require_non_empty
from cubegraph.session import materialise_table
from cubegraph.sources import reaimed


@dataclass(frozen=True)
class Star:
    """Stored tables of one load."""

    readings: DataFrame
    climate: DataFrame
    dim_time: DataFrame
    dim_location: DataFrame
    dim_level: DataFrame
    fact: DataFrame
    fact_climate: DataFrame


def build_star(readings: DataFrame, climate: DataFrame, box: Box = AREA, dealt: bool = False) -> Star:
    """Load a star schema; every table is stored once and read from there.

    ``dealt`` states that the readings leave an exchange, so their files are even without another one.

    Guards stop the load when the unit dimension is empty or none of its units
    received a coordinate.
    """
    # Even files, however few the source has: what is derived from them is as parallel as they are.
    staged = materialise_table(readings if dealt else readings.hint("rebalance"), "stg-consumo")
    weather = materialise_table(climate.hint("rebalance"), "stg-clima")
    members = materialise_table(dims.members(staged, box), "members")
    dim_time = materialise_table(dims.build_dim_time(weather), "dim-tiempo")
    dim_level = materialise_table(dims.build_dim_level(members), "dim-indice")
    units = require_non_empty(dims.build_dim_location(members), "no unit has a name")
    located = dims.attach_centroids(units, dims.centroids_of(members))
    dim_location = materialise_table(located, "dim-ubicacion")
    require_coordinates(dim_location)
    fact = facts.build_fact_consumption(staged, dim_time, dim_location, dim_level)
    weather_fact = facts.build_fact_climate(weather, dim_time)
    return Star(
        readings=staged,
        climate=weather,
        dim_time=dim_time,
        dim_location=dim_location,
        dim_level=dim_level,
        fact=materialise_table(with_serial(fact, "id_fact"), "fact-consumo"),
        fact_climate=materialise_table(
            with_surrogate_key(weather_fact, ["id_tiempo"], "id_fact_clima"), "fact-clima"
        ),
    )


def load_star(spark: SparkSession, sf_dir: str) -> Star:
    """Star over the tables of ``sf_dir``."""
    return build_star(reaimed.readings(spark, sf_dir), reaimed.climate(spark, sf_dir), dealt=True)
