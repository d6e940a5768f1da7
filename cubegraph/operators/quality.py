"""Guards, audits and reconciliations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.dates import try_date
from cubegraph.functions.geo import AREA, Box, in_bbox
from cubegraph.functions.numbers import try_number
from cubegraph.functions.text import is_missing
from cubegraph.operators.relational import first_match, values_df

# Criterion names of the audits, in order of attribution.
NO_LABEL = "Unmatched territorial label"
NO_LEVEL = "Missing development index"
NO_DAY = "Date absent from dim_tiempo"
NO_MEASURE = "Missing or non-numeric measure"
NO_COORDINATE = "Null or out-of-range coordinates"
NO_DATE = "Unparseable reading date"
LOADED = "Loaded into the fact table"
DISCARDED = "Total discarded"
SOURCE = "Source records read"
MIN_BOROUGHS = 16


class QualityError(ValueError):
    """A guard found data the next step must not run on."""


def require_non_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise QualityError(message)
    return df


def require_coordinates(dim: DataFrame) -> dict[str, int]:
    """Counts of units with and without a coordinate; fails if none has one."""
    row = dim.agg(
        F.count("*").alias("units"), F.count("latitud").alias("located")
    ).first()
    if row.located == 0:
        raise QualityError("no unit received a coordinate")
    return {"units": row.units, "located": row.located}


def require_cardinality(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    found = df.count()
    if found != n:
        raise QualityError(f"expected {n} {what}, found {found}")
    return df


def loss_audit(rows: DataFrame, criteria: Sequence[tuple[str, Column]]) -> DataFrame:
    """Records per criterion, each row counted at the first one it meets.

    Criteria nobody meets show zero; totals of discarded, loaded and read rows follow.
    """
    reason = first_match(criteria, otherwise=LOADED)
    counted = rows.groupBy(reason.alias("criterion")).agg(F.count("*").alias("records"))
    lines = [name for name, _ in criteria] + [LOADED]
    listed = values_df(rows.sparkSession, [(n, i) for i, n in enumerate(lines)], "criterion string, ord int")
    full = listed.join(counted, "criterion", "left").select(
        "ord", "criterion", F.coalesce("records", F.lit(0)).alias("records")
    )
    discarded = F.when(F.col("criterion") != LOADED, F.col("records")).otherwise(0)
    # Each listed line also feeds the totals it belongs to.
    flat = full.select(
        F.explode(
            F.array(
                F.struct("criterion", "records"),
                F.struct(F.lit(DISCARDED).alias("criterion"), discarded.alias("records")),
                F.struct(F.lit(SOURCE).alias("criterion"), F.col("records")),
            )
        ).alias("e")
    ).select("e.*")
    lines_and_totals = flat.groupBy("criterion").agg(F.sum("records").alias("records"))
    total = lines_and_totals.filter(F.col("criterion") == SOURCE).select("records").scalar()
    return lines_and_totals.select(
        "criterion",
        "records",
        F.round(F.lit(100.0) * F.col("records") / F.nullif(total, F.lit(0)), 2).alias("pct"),
    )


def load_audit(readings: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Why readings do not reach the fact table, in the order of its joins."""
    days = dim_time.select(F.col("fecha").alias("fecha_referencia"), F.lit(True).alias("_known"))
    marked = readings.select("alcaldia", "colonia", "indice_des", "fecha_referencia").join(
        days, "fecha_referencia", "left"
    )
    return loss_audit(
        marked,
        [
            (NO_LABEL, is_missing(F.col("colonia")) | is_missing(F.col("alcaldia"))),
            (NO_LEVEL, is_missing(F.col("indice_des"))),
            (NO_DAY, F.col("_known").isNull()),
        ],
    )


def cleaning_audit(raw: DataFrame, day: str = "fecha_referencia", box: Box = AREA) -> DataFrame:
    """Source-side audit of text columns: measure, coordinates, label, date."""
    lat = try_number(F.col("latitud").cast("string"))
    lon = try_number(F.col("longitud").cast("string"))
    inside = F.coalesce(in_bbox(lat, lon, box), F.lit(False))
    return loss_audit(
        raw,
        [
            (NO_MEASURE, try_number(F.col("consumo_total").cast("string")).isNull()),
            (NO_COORDINATE, ~inside),
            (NO_LABEL, F.col("alcaldia").isNull() | F.col("colonia").isNull()),
            (NO_DATE, try_date(F.col(day).cast("string")).isNull()),
        ],
    )


def cardinalities(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tabla"), "n")
            for name, df in tables.items()
        ],
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    """First, last and number of distinct days."""
    days = df.select(column).distinct()
    return days.agg(
        F.min(column).alias("desde"), F.max(column).alias("hasta"), F.count(column).alias("dias")
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key the dimension lacks; a null key references nothing."""
    return fact.filter(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def head_nulls(mart: DataFrame, order: Sequence[Column | str], column: str, n: int = 100) -> DataFrame:
    """How many of the first ``n`` rows lack a value: a one-row frame."""
    head = mart.orderBy(*order).limit(n)
    return head.agg(F.count_if(F.col(column).isNull()).alias("n"))


def validate_export(
    mart: DataFrame, corr: DataFrame, order: Sequence[Column | str], min_boroughs: int = MIN_BOROUGHS
) -> DataFrame:
    """Problems that forbid an export, as (problem, n); empty when there are none."""
    boroughs = mart.select("alcaldia").distinct().agg(F.count("*").alias("n")).scalar()
    facts = mart.agg(
        F.count("*").alias("rows"), F.count_if(F.col("latitud").isNull()).alias("unplaced")
    ).select(
        "rows",
        "unplaced",
        boroughs.alias("boroughs"),
        corr.agg(F.count("*")).scalar().alias("corr"),
        head_nulls(mart, order, "consumo_total").scalar().alias("head_nulls"),
    )
    checks = [
        ("mart is empty", F.col("rows"), F.col("rows") == 0),
        ("too few boroughs", F.col("boroughs"), F.col("boroughs") < min_boroughs),
        ("correlation is empty", F.col("corr"), F.col("corr") == 0),
        ("first rows without a total", F.col("head_nulls"), F.col("head_nulls") > 0),
        ("rows without a coordinate", F.col("unplaced"), F.col("unplaced") > 0),
    ]
    entries = [
        F.when(bad, F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n")))
        for name, n, bad in checks
    ]
    return (
        facts.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    )


def reconcile_totals(graph_totals: DataFrame, star_totals: DataFrame) -> DataFrame:
    """Both totals per bimester and whether they agree; a missing side disagrees."""
    g = graph_totals.select("anio", "bimestre", F.col("agua").alias("grafo"))
    s = star_totals.select("anio", "bimestre", F.col("total_agua").alias("almacen"))
    return g.join(s, ["anio", "bimestre"], "full").withColumn(
        "coincide", F.coalesce(F.col("grafo") == F.col("almacen"), F.lit(False))
    )
