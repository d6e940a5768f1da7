"""Roll-ups that are kept up to date: sums and counts of every batch, added up when they are read.

A batch of facts is reduced to three grains, each from the one before: unit, day and level; unit and bimester; unit. The
reduced rows are stored under the batch's name, so loading a batch again replaces it, and an append
writes rows for its own readings only. Sums and counts of batches add up, so a roll-up over all batches equals one over all
facts, and reads the coarsest grain that serves it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cubegraph.operators.facts import MEASURES
from cubegraph.session import shared_path

DAYS = ("id_ubicacion", "id_tiempo", "id_indice_des")
PERIODS = ("id_ubicacion", "anio", "bimestre")
UNITS = ("id_ubicacion",)
#: Additive columns: how many readings, and the sum and count of every measure.
STATE = ("registros", *[f"{part}_{m}" for m in MEASURES for part in ("suma", "n")])


def reduced(fact: DataFrame) -> DataFrame:
    """Facts at the finest grain."""
    parts = [c for m in MEASURES for c in (F.sum(m).alias(f"suma_{m}"), F.count(m).alias(f"n_{m}"))]
    return fact.groupBy(*DAYS).agg(F.count("*").alias("registros"), *parts)


def added(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State rows at a coarser grain."""
    return state.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATE])


def mean(measure: str) -> Column:
    """The mean from a carried sum and count; null where nothing was counted."""
    return F.col(f"suma_{measure}").cast("double") / F.nullif(F.col(f"n_{measure}"), F.lit(0))


class RollupState:
    """The three grains of all batches merged so far, in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "rollup")

    def merge(self, fact: DataFrame, dim_time: DataFrame, batch: str) -> None:
        """Add a batch; a batch of that name, whole or half written, is replaced.

        Batches must not share readings. Every grain is written from the stored finer one.
        """
        self._write(reduced(fact), "days", batch)
        days = self._read("days").filter(F.col("batch") == batch)
        periods = days.join(dim_time.select("id_tiempo", "anio", "bimestre"), "id_tiempo")
        self._write(added(periods, PERIODS), "periods", batch)
        self._write(added(self._read("periods").filter(F.col("batch") == batch), UNITS), "units", batch)

    def _write(self, rows: DataFrame, grain: str, batch: str) -> None:
        named = rows.withColumn("batch", F.lit(batch))
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
        writer.parquet(f"{self.path}/{grain}")

    def _read(self, grain: str) -> DataFrame:
        """A grain's rows; names of batches are texts, whatever they look like."""
        folder = f"{self.path}/{grain}"
        fields = [f for f in self.spark.read.parquet(folder).schema if f.name != "batch"]
        return self.spark.read.schema(StructType([*fields, StructField("batch", StringType())])).parquet(folder)

    def days(self) -> DataFrame:
        """State at (unit, day, level), a row per key."""
        return added(self._read("days"), DAYS)

    def periods(self) -> DataFrame:
        """State at (unit, year, bimester), a row per key."""
        return added(self._read("periods"), PERIODS)

    def units(self) -> DataFrame:
        """State at (unit), a row per key and batch: its readers add up anyway."""
        return self._read("units").drop("batch")
