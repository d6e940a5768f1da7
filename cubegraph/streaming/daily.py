"""The daily roll-up over a series that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.operators.facts import stable_mean


def daily_rollup_stream(climate: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Days of a stream with the measures of the batch roll-up.

    A day is emitted once the watermark has passed it; state holds one row of
    running sums per open day.
    """
    day = F.window("fecha_hora", "1 day")
    return (
        climate.withWatermark("fecha_hora", lateness)
        .groupBy(day.alias("w"))
        .agg(
            F.max("temperatura").alias("temp_maxima"),
            F.min("temperatura").alias("temp_minima"),
            stable_mean("temperatura").alias("temp_promedio"),
            F.avg("humedad_relativa").alias("humedad_promedio"),
            F.sum("lluvia").alias("lluvia_total"),
        )
        .select(F.to_date("w.start").alias("fecha"), "temp_maxima", "temp_minima", "temp_promedio", "humedad_promedio", "lluvia_total")
    )
