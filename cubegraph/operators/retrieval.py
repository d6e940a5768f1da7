"""Filtered retrieval over the mart: indicators, profiles, search and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.numbers import choropleth_class
from cubegraph.functions.text import contains_folded, fold, is_present, rlike
from cubegraph.operators.names import NameIndex
from cubegraph.operators.ordering import minmax_scale, top


def retrieve(
    mart: DataFrame,
    anio: int | None = None,
    bimestre: int | None = None,
    alcaldia: str | None = None,
    colonia: str | None = None,
    indice: str | None = None,
) -> DataFrame:
    """Conjunction of the parameters that are set; an empty one constrains nothing."""
    wanted = {
        "anio": anio,
        "bimestre": bimestre,
        "alcaldia": alcaldia,
        "colonia": colonia,
        "indice_des": indice,
    }
    out = mart
    for column, value in wanted.items():
        if value not in (None, ""):
            out = out.filter(F.col(column) == F.lit(value))
    return out


def _total(column: str) -> Column:
    """Sum as a number, zero over nothing."""
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def _filled_mean(column: str) -> Column:
    """Sum with nulls as zero, divided by the number of rows (not of values)."""
    return F.coalesce(_total(column) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def _members(column: str) -> Column:
    """Distinct values, null counting as one of them."""
    return F.count_distinct(F.col(column)) + F.coalesce(
        F.max(F.col(column).isNull().cast("long")), F.lit(0)
    )


def kpis(filtered: DataFrame) -> DataFrame:
    """Rows, total, zero-filled mean and distinct non-empty neighbourhood names."""
    return filtered.agg(
        F.count("*").alias("registros"),
        _total("consumo_total").alias("total"),
        _filled_mean("consumo_prom").alias("promedio"),
        F.count_distinct(F.nullif(F.col("colonia"), F.lit(""))).alias("colonias"),
    )


_PROFILE_SUMS = (
    "consumo_total", "consumo_total_dom", "consumo_total_no_dom", "consumo_total_mixto"
)
_PROFILE_MEANS = ("consumo_prom", "consumo_prom_dom", "consumo_prom_mixto", "consumo_prom_no_dom")


def _profile() -> list[Column]:
    return [
        *[_total(c).alias(c) for c in _PROFILE_SUMS],
        *[_filled_mean(c).alias(c) for c in _PROFILE_MEANS],
        _members("colonia").alias("num_colonias"),
        F.count("*").alias("num_registros"),
    ]


def borough_profile_all(filtered: DataFrame) -> DataFrame:
    """Sums, zero-filled means, rows and members per borough, largest first.

    Pre-reduced per (borough, neighbourhood), so the distinct count never
    gathers the rows of one borough.
    """
    units = filtered.groupBy("alcaldia", "colonia").agg(
        *[F.sum(c).alias(c) for c in (*_PROFILE_SUMS, *_PROFILE_MEANS)],
        F.count("*").alias("_rows"),
    )
    rows = F.sum("_rows")
    return (
        units.groupBy("alcaldia")
        .agg(
            *[_total(c).alias(c) for c in _PROFILE_SUMS],
            *[(_total(c) / rows).alias(c) for c in _PROFILE_MEANS],
            F.count("*").alias("num_colonias"),
            rows.alias("num_registros"),
        )
        .orderBy(F.desc("consumo_total"), F.asc_nulls_last("alcaldia"))
    )


def borough_profile(filtered: DataFrame, name: str) -> DataFrame:
    """One row for the borough of that name, found by folded name; flagged when empty."""
    rows = filtered.filter(fold(F.col("alcaldia")) == fold(F.lit(name)))
    return rows.agg(
        *_profile(), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max")
    ).select(
        F.lit(name).alias("alcaldia"), "*", (F.col("num_registros") == 0).alias("sin_datos")
    )


def totals_by_neighbourhood(rows: DataFrame) -> DataFrame:
    return rows.groupBy("colonia", "alcaldia").agg(_total("consumo_total").alias("total"))


def totals_by_borough(filtered: DataFrame) -> DataFrame:
    """Total per named borough, largest first."""
    return (
        filtered.filter(is_present(F.col("alcaldia")))
        .groupBy("alcaldia")
        .agg(_total("consumo_total").alias("total"))
        .orderBy(F.desc("total"), "alcaldia")
    )


def correlation_panel(corr: DataFrame, filtered: DataFrame, anio: int | None = None) -> DataFrame:
    """Correlation rows, of one year if it is given, whose total is the filtered one where the filter left any."""
    if anio is not None:
        corr = corr.filter(F.col("anio") == anio)
    kept = filtered.groupBy("anio", "bimestre").agg(_total("consumo_total").alias("_filtered"))
    return corr.join(kept, ["anio", "bimestre"], "left").select(
        *[
            F.coalesce("_filtered", F.col("total_agua").cast("double")).alias(c)
            if c == "total_agua"
            else F.col(c)
            for c in corr.columns
        ]
    )


def search(
    dim: DataFrame,
    text: str,
    alcaldia: str | None = None,
    min_chars: int = 3,
    limit: int = 40,
    name: str = "colonia",
    tie: str = "id_ubicacion",
    index: NameIndex | None = None,
) -> DataFrame:
    """First ``limit`` units by Spanish order whose name holds the text, folded; found by ``index`` where there is one."""
    if len(text.strip()) < min_chars:
        return dim.limit(0)
    hits = index.search(text) if index else dim.filter(contains_folded(F.col(name), text))
    if alcaldia:
        hits = hits.filter(fold(F.col("alcaldia")) == fold(F.lit(alcaldia)))
    return top(hits, [F.collate(F.col(name), "es"), tie], limit)


# Fixed value: names preferred for the first unit shown.
FIRST_SHOWN = "CENTRO|JUAREZ|ROMA"


def initial_selection(
    dim: DataFrame, colonia: str | None = None, alcaldia: str | None = None, pattern: str = FIRST_SHOWN
) -> DataFrame:
    """The unit shown first: the requested name, else a pattern match, else the first.

    The requested name may lie in any borough; the fallbacks respect the filter.
    """
    inside = (
        fold(F.col("alcaldia")) == fold(F.lit(alcaldia)) if alcaldia else F.lit(True)
    )
    asked = fold(F.col("colonia")) == fold(F.lit(colonia)) if colonia else F.lit(False)
    priority = (
        F.when(asked, 0).when(inside & rlike(F.col("colonia"), pattern), 1).when(inside, 2)
    )
    return (
        dim.withColumn("prioridad", priority)
        .filter(F.col("prioridad").isNotNull())
        .orderBy("prioridad", F.collate(F.col("colonia"), "es"), "id_ubicacion")
        .limit(1)
    )


def reconcile(polygons: DataFrame, data: DataFrame, name: str = "nombre") -> DataFrame:
    """Polygons with the row of their borough: exact name first, else folded name.

    Among boroughs that fold alike the one with the smallest total wins: profiles
    come largest first, and the last entry of a name stays.
    """
    columns = [c for c in data.columns if c != "alcaldia"]
    named = data.filter(is_present(F.col("alcaldia")))
    exact = named.select(
        F.col("alcaldia").alias(name), F.struct("alcaldia", *columns).alias("_exact")
    )
    folded = named.groupBy(fold(F.col("alcaldia")).alias("_fold")).agg(
        F.min_by(F.struct("alcaldia", *columns), F.struct("consumo_total", "alcaldia")).alias("_folded")
    )
    return (
        polygons.withColumn("_fold", fold(F.col(name)))
        .join(exact, name, "left")
        .join(folded, "_fold", "left")
        .withColumn("_row", F.coalesce("_exact", "_folded"))
        .select(
            *polygons.columns,
            F.col("_row.alcaldia").alias("alcaldia"),
            *[F.col(f"_row.{c}").alias(c) for c in columns],
        )
    )


def choropleth(profiles: DataFrame, column: str = "consumo_total") -> DataFrame:
    """Scaled value and shade of each borough."""
    scaled = minmax_scale(profiles, column, "escala")
    return scaled.withColumn("clase", choropleth_class(F.col("escala")))


def named_neighbours(points: DataFrame, result: DataFrame, self_id) -> DataFrame:
    """Units highlighted for a result: every unit with a listed name but itself."""
    listed = result.select(F.col("vecina").alias("colonia")).distinct()
    return points.join(listed, "colonia", "left_semi").filter(F.col("id_ubicacion") != self_id)


def catalogue(mart: DataFrame) -> DataFrame:
    """Distinct filter values as rows (kind, parent, value).

    One pass, no arrays: a borough with many neighbourhoods stays many rows.
    """
    text = {c: F.col(c).cast("string") for c in ("anio", "bimestre", "alcaldia", "indice_des")}
    entries = [
        F.struct(F.lit(kind).alias("kind"), parent.alias("parent"), value.alias("value"))
        for kind, parent, value in (
            ("anio", F.lit(None).cast("string"), text["anio"]),
            ("bimestre", F.lit(None).cast("string"), text["bimestre"]),
            ("alcaldia", F.lit(None).cast("string"), text["alcaldia"]),
            ("indice", F.lit(None).cast("string"), text["indice_des"]),
            ("colonia", text["alcaldia"], F.col("colonia")),
        )
    ]
    return mart.select(F.explode(F.array(*entries)).alias("e")).select("e.*").distinct()
