"""Roll-ups, retrieval and indicators over the star and the mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubegraph.functions import dates
from cubegraph.functions.geo import AREA, in_bbox
from cubegraph.operators import marts, ordering, quality, relational, retrieval, rollup
from cubegraph.plans.registered.base import Query, registrar
from cubegraph.session import shared_path
from cubegraph.sources import readers, schemas, writers

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


def _doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _page(first: int, last: int) -> str:
    """SQL for the rows first..last of the retrieval order, counted from 1."""
    order = "anio, bimestre, alcaldia, colonia, fecha, indice_des, consumo_total, consumo_prom"
    return f"""
SELECT anio, bimestre, CAST(fecha AS VARCHAR) AS fecha, alcaldia, colonia, indice_des,
  CAST(consumo_total AS DOUBLE) AS consumo_total, CAST(consumo_prom AS DOUBLE) AS consumo_prom
FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS lugar
  FROM fact_consumo_agua NATURAL JOIN dim_tiempo NATURAL JOIN dim_ubicacion NATURAL JOIN dim_indice_des)
WHERE lugar BETWEEN {first} AND {last}"""


@query(_page(201, 300))
def paged_retrieval(c):
    """The third page of a hundred, read from the files of the order index that hold it."""
    page = c.ordered.page(limit=100, offset=200)
    return _doubles(page, "consumo_total", "consumo_prom").withColumn("fecha", dates.iso_date(F.col("fecha")))


@query(_page(30_001, 30_100))
def deep_page(c):
    """A page far into the order costs what the first one does."""
    page = c.ordered.page(limit=100, offset=30_000)
    return _doubles(page, "consumo_total", "consumo_prom").withColumn("fecha", dates.iso_date(F.col("fecha")))


_BY_BOROUGH = """
WITH unidad AS (SELECT id_ubicacion, COUNT(*) AS r, SUM(consumo_total) AS t, SUM(consumo_prom) AS p, COUNT(consumo_prom) AS k,
    SUM(consumo_total_no_dom) AS d FROM fact_consumo_agua GROUP BY id_ubicacion),
zona AS (SELECT alcaldia, CAST(SUM(r) AS BIGINT) AS registros, CAST(SUM(t) AS DOUBLE) AS total, CAST(SUM(d) AS DOUBLE) AS no_dom,
    CAST(SUM(p) AS DOUBLE) / CAST(SUM(k) AS DOUBLE) AS promedio FROM unidad NATURAL JOIN dim_ubicacion GROUP BY alcaldia)
SELECT *, CASE WHEN total <> 0 THEN CAST(100 AS DOUBLE) * no_dom / total END AS pct_no_dom FROM zona"""


@query(_BY_BOROUGH)
def by_borough(c):
    return _doubles(marts.by_borough(c.rollup.units(), c.star.dim_location), "total", "no_dom")


def _in_batches(c):
    """The state after readings of even and odd days were appended as two batches, the second one twice."""
    state, fact = rollup.RollupState(c.spark), c.star.fact
    for batch in ("even", "odd", "odd"):
        state.merge(fact.filter(F.col("id_tiempo") % 2 == ("even", "odd").index(batch)), c.star.dim_time, batch)
    return state


@query(_BY_BOROUGH)
def by_borough_after_appends(c):
    return _doubles(marts.by_borough(_in_batches(c).units(), c.star.dim_location), "total", "no_dom")


@query("""
WITH dia AS (SELECT id_ubicacion, id_tiempo, SUM(consumo_total) AS t, SUM(consumo_prom) AS p, COUNT(consumo_prom) AS k
  FROM fact_consumo_agua GROUP BY id_ubicacion, id_tiempo),
periodo AS (SELECT id_ubicacion, anio, bimestre, CAST(SUM(t) AS DOUBLE) AS total, CAST(SUM(p) AS DOUBLE) / CAST(SUM(k) AS DOUBLE) AS promedio
  FROM dia NATURAL JOIN dim_tiempo GROUP BY id_ubicacion, anio, bimestre)
SELECT alcaldia, colonia, anio, bimestre, total, promedio FROM periodo JOIN dim_ubicacion USING (id_ubicacion)""")
def by_neighbourhood_bimester(c):
    return _doubles(marts.by_neighbourhood_bimester(c.rollup.periods(), c.star.dim_location), "total")


@query("""
SELECT u.alcaldia, u.colonia, CAST(SUM(f.consumo_total) AS DOUBLE) AS total
FROM fact_consumo_agua f JOIN dim_ubicacion u USING (id_ubicacion)
GROUP BY u.id_ubicacion, u.alcaldia, u.colonia ORDER BY total DESC, u.id_ubicacion LIMIT 10""")
def top10_neighbourhoods(c):
    return _doubles(marts.top_neighbourhoods(c.rollup.units(), c.star.dim_location, 10), "total")


_MEASURES = (
    "consumo_total", "consumo_prom", "consumo_total_dom", "consumo_prom_dom",
    "consumo_total_mixto", "consumo_prom_mixto", "consumo_total_no_dom", "consumo_prom_no_dom",
)


@query(f"""
SELECT anio, bimestre, CAST(fecha AS VARCHAR) AS fecha, alcaldia, colonia, indice_des,
  CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud,
  {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _MEASURES)} FROM mart""")
def export_mart(c):
    s = c.star
    mart = marts.build_mart(s.fact, s.dim_time, s.dim_location, s.dim_level)
    return _doubles(mart, "latitud", "longitud", *_MEASURES).withColumn("fecha", dates.iso_date(F.col("fecha")))


@query("""
SELECT kind, parent, value FROM (
  SELECT DISTINCT 'anio' AS kind, CAST(NULL AS VARCHAR) AS parent, CAST(anio AS VARCHAR) AS value FROM mart
  UNION SELECT 'bimestre', NULL, CAST(bimestre AS VARCHAR) FROM mart
  UNION SELECT 'alcaldia', NULL, alcaldia FROM mart
  UNION SELECT 'indice', NULL, indice_des FROM mart
  UNION SELECT 'colonia', alcaldia, colonia FROM mart)""")
def catalogue(c):
    return retrieval.catalogue(c.mart)


@query("""
SELECT alcaldia, COUNT(DISTINCT colonia) AS colonias, MIN(colonia) AS primera, MAX(colonia) AS ultima
FROM mart GROUP BY alcaldia""")
def borough_members(c):
    members = retrieval.catalogue(c.mart).filter(F.col("kind") == "colonia")
    return members.groupBy(F.col("parent").alias("alcaldia")).agg(
        F.count("value").alias("colonias"),
        F.min("value").alias("primera"),
        F.max("value").alias("ultima"),
    )


@query("""
SELECT problem, n FROM (
  SELECT 'mart is empty' AS problem, COUNT(*) AS n, COUNT(*) = 0 AS bad FROM mart
  UNION ALL SELECT 'too few boroughs', COUNT(DISTINCT alcaldia), COUNT(DISTINCT alcaldia) < 30 FROM mart
  UNION ALL SELECT 'correlation is empty', COUNT(*), COUNT(*) = 0 FROM correlacion
  UNION ALL SELECT 'first rows without a total', COUNT(*), COUNT(*) > 0 FROM (
    SELECT consumo_total FROM mart ORDER BY anio, bimestre, alcaldia, colonia, fecha, indice_des LIMIT 100) WHERE consumo_total IS NULL
  UNION ALL SELECT 'rows without a coordinate', COUNT(*), COUNT(*) > 0 FROM mart WHERE latitud IS NULL) WHERE bad""")
def validate_export(c):
    s = c.star
    corr = marts.correlation(s.fact, s.fact_climate, s.dim_time)
    return quality.validate_export(c.mart, corr, marts.mart_order(), min_boroughs=30)


@query("""
SELECT anio, bimestre, ROUND(CAST(total_agua AS DOUBLE), 2) AS total_agua, temp_promedio, dias_ola_calor, dias_frio,
  ROUND(CAST(total_lluvia AS DOUBLE), 2) AS total_lluvia FROM correlacion""")
def export_correlation(c):
    s = c.star
    return writers.correlation_rows(marts.correlation(s.fact, s.fact_climate, s.dim_time, rounded=True))


@query("""
SELECT COUNT(*) AS registros, COALESCE(CAST(SUM(consumo_total) AS DOUBLE), 0.0) AS total,
  ROUND(SUM(COALESCE(consumo_prom, 0.0))/COUNT(*), 6) AS promedio, COUNT(DISTINCT NULLIF(colonia, '')) AS colonias
FROM mart WHERE anio = 1998 AND alcaldia = 'NATION_3'""")
def filtered_kpis(c):
    shown = retrieval.retrieve(c.mart, anio=1998, alcaldia="NATION_3")
    return retrieval.kpis(shown).withColumn("promedio", F.round("promedio", 6))


_PROFILE_SQL = """
  CAST(SUM(consumo_total) AS DOUBLE) AS consumo_total, CAST(SUM(consumo_total_dom) AS DOUBLE) AS consumo_total_dom,
  CAST(SUM(consumo_total_no_dom) AS DOUBLE) AS consumo_total_no_dom, CAST(SUM(consumo_total_mixto) AS DOUBLE) AS consumo_total_mixto,
  ROUND(SUM(COALESCE(consumo_prom,0.0))/COUNT(*),6) AS consumo_prom, ROUND(SUM(COALESCE(consumo_prom_dom,0.0))/COUNT(*),6) AS consumo_prom_dom,
  ROUND(SUM(COALESCE(consumo_prom_mixto,0.0))/COUNT(*),6) AS consumo_prom_mixto,
  ROUND(SUM(COALESCE(consumo_prom_no_dom,0.0))/COUNT(*),6) AS consumo_prom_no_dom,
  COUNT(DISTINCT colonia) AS num_colonias, COUNT(*) AS num_registros"""


def _rounded_means(df):
    names = ("consumo_prom", "consumo_prom_dom", "consumo_prom_mixto", "consumo_prom_no_dom")
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"SELECT alcaldia, {_PROFILE_SQL} FROM mart WHERE bimestre = 2 GROUP BY alcaldia")
def borough_map(c):
    return _rounded_means(retrieval.borough_profile_all(retrieval.retrieve(c.mart, bimestre=2)))


@query(f"""
SELECT ' nátion_7 ' AS alcaldia, {_PROFILE_SQL}, MIN(anio) AS anio_min, MAX(anio) AS anio_max, COUNT(*) = 0 AS sin_datos
FROM mart WHERE alcaldia = 'NATION_7'""")
def borough_profile(c):
    return _rounded_means(retrieval.borough_profile(c.mart, " nátion_7 "))


@query("""
SELECT 'Atlántida' AS alcaldia, 0.0::DOUBLE AS consumo_total, 0.0::DOUBLE AS consumo_total_dom, 0.0::DOUBLE AS consumo_total_no_dom,
  0.0::DOUBLE AS consumo_total_mixto, 0.0::DOUBLE AS consumo_prom, 0.0::DOUBLE AS consumo_prom_dom, 0.0::DOUBLE AS consumo_prom_mixto,
  0.0::DOUBLE AS consumo_prom_no_dom, COUNT(*) AS num_colonias, COUNT(*) AS num_registros,
  MIN(anio) AS anio_min, MAX(anio) AS anio_max, COUNT(*) = 0 AS sin_datos
FROM mart WHERE alcaldia = 'ATLANTIDA'""")
def borough_profile_empty(c):
    return retrieval.borough_profile(c.mart, "Atlántida")


@query("""
SELECT alcaldia, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart WHERE indice_des = '5-LOW' GROUP BY alcaldia""")
def totals_by_borough(c):
    return retrieval.totals_by_borough(retrieval.retrieve(c.mart, indice="5-LOW"))


@query("""
SELECT colonia, alcaldia, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart WHERE anio = 1999
GROUP BY colonia, alcaldia ORDER BY total DESC, colonia, alcaldia LIMIT 10""")
def filtered_top_neighbourhoods(c):
    totals = retrieval.totals_by_neighbourhood(retrieval.retrieve(c.mart, anio=1999))
    return ordering.top(totals, [F.desc("total"), "colonia", "alcaldia"], 10)


@query("""
SELECT alcaldia, CAST(SUM(consumo_total) AS DOUBLE) AS consumo_total FROM mart GROUP BY alcaldia
ORDER BY consumo_total DESC, alcaldia LIMIT 8""")
def top8_boroughs(c):
    profiles = retrieval.borough_profile_all(c.mart).select("alcaldia", "consumo_total")
    return ordering.top(profiles, [F.desc("consumo_total"), "alcaldia"], 8)


@query("""
SELECT total, pages, page, CASE WHEN total = 0 THEN 0 ELSE (page-1)*50+1 END AS row_from, LEAST(page*50, total) AS row_to,
  page = 1 AS is_first, page >= pages AS is_last
FROM (SELECT total, pages, CAST(LEAST(GREATEST(1, 9999), pages) AS BIGINT) AS page
  FROM (SELECT COUNT(*) AS total, CAST(GREATEST(1, CEIL(COUNT(*)/50.0)) AS BIGINT) AS pages
    FROM mart WHERE colonia <> '' AND anio = 1998))""")
def page_info(c):
    """A jump past the end lands on the last page."""
    total = retrieval.retrieve(c.mart, anio=1998).agg(F.count("*").alias("total"))
    return ordering.page_info(total, size=50, page_no=9999)


@query("""
SELECT k.anio, k.bimestre, COALESCE(m.total, CAST(k.total_agua AS DOUBLE)) AS total_agua, k.temp_promedio
FROM correlacion k LEFT JOIN (
  SELECT anio, bimestre, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart
  WHERE alcaldia = 'NATION_3' AND bimestre = 2 GROUP BY anio, bimestre) m USING (anio, bimestre)""")
def correlation_with_fallback(c):
    s = c.star
    corr = marts.correlation(s.fact, s.fact_climate, s.dim_time)
    shown = retrieval.retrieve(c.mart, alcaldia="NATION_3", bimestre=2)
    return retrieval.correlation_panel(corr, shown).select("anio", "bimestre", "total_agua", "temp_promedio")


@query("""
SELECT k.anio, k.bimestre, COALESCE(m.total, CAST(k.total_agua AS DOUBLE)) AS total_agua, k.temp_promedio
FROM correlacion k LEFT JOIN (
  SELECT anio, bimestre, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart
  WHERE alcaldia = 'NATION_3' AND bimestre = 2 AND anio = 1995 GROUP BY anio, bimestre) m USING (anio, bimestre)
WHERE k.anio = 1995""")
def correlation_of_a_year(c):
    s = c.star
    corr = marts.correlation(s.fact, s.fact_climate, s.dim_time)
    shown = retrieval.retrieve(c.mart, alcaldia="NATION_3", anio=1995, bimestre=2)
    return retrieval.correlation_panel(corr, shown, anio=1995).select("anio", "bimestre", "total_agua", "temp_promedio")


@query("""
SELECT alcaldia, total AS consumo_total, ROUND(t, 6) AS escala,
  CASE WHEN t IS NULL THEN 0 WHEN t < 0.2 THEN 1 WHEN t < 0.4 THEN 2 WHEN t < 0.6 THEN 3 WHEN t < 0.8 THEN 4 ELSE 5 END AS clase
FROM (SELECT alcaldia, total, (total - MIN(total) OVER ()) / (MAX(total) OVER () - MIN(total) OVER ()) AS t
  FROM (SELECT alcaldia, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart GROUP BY alcaldia))""")
def choropleth_classes(c):
    shaded = retrieval.choropleth(retrieval.borough_profile_all(c.mart))
    return shaded.select("alcaldia", "consumo_total", F.round("escala", 6).alias("escala"), "clase")


@query("""
SELECT p.nombre, m.alcaldia, m.total AS consumo_total FROM (
  SELECT CASE WHEN n_nationkey % 2 = 0 THEN SUBSTR(n_name,1,1) || LOWER(SUBSTR(n_name,2)) ELSE n_name END AS nombre FROM nation
  UNION ALL SELECT r_name FROM region) p
LEFT JOIN (SELECT alcaldia, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM mart GROUP BY alcaldia) m ON LOWER(p.nombre) = LOWER(m.alcaldia)""")
def reconcile_names(c):
    """Polygon names in title case or as stored, and some no borough has."""
    name = F.col("n_name")
    title = F.concat(F.substring(name, 1, 1), F.lower(F.substr(name, F.lit(2))))
    polygons = c.table("nation").select(
        F.when(F.col("n_nationkey") % 2 == 0, title).otherwise(name).alias("nombre")
    ).unionByName(c.table("region").select(F.col("r_name").alias("nombre")))
    profiles = retrieval.borough_profile_all(c.mart).select("alcaldia", "consumo_total")
    return retrieval.reconcile(polygons, profiles).select("nombre", "alcaldia", "consumo_total")


@query("""
SELECT id_ubicacion, alcaldia, colonia FROM dim_ubicacion
WHERE CONTAINS(LOWER(colonia), 'r#00000') AND LOWER(alcaldia) = 'nation_3' ORDER BY colonia, id_ubicacion LIMIT 40""")
def search_units(c):
    return retrieval.search(c.star.dim_location, "R#00000", alcaldia="Nation_3", index=c.names).select(
        "id_ubicacion", "alcaldia", "colonia"
    )


@query("""
SELECT id_ubicacion, colonia, CASE WHEN REGEXP_MATCHES(colonia, '7$') THEN 1 ELSE 2 END AS prioridad
FROM dim_ubicacion WHERE alcaldia = 'NATION_7' ORDER BY prioridad, colonia, id_ubicacion LIMIT 1""")
def initial_selection(c):
    chosen = retrieval.initial_selection(c.star.dim_location, alcaldia="nation_7", pattern="7$")
    return chosen.select("id_ubicacion", "colonia", "prioridad")


@query("""
SELECT id_ubicacion, id_tiempo, id_indice_des, CAST(consumo_total AS DOUBLE) AS consumo_total, consumo_prom, registros
FROM aggobs""")
def aggregate_observations(c):
    rows = marts.aggregate_observations(c.star.fact, c.star.dim_level)
    return rows.select(
        "id_ubicacion", "id_tiempo", "id_indice_des",
        F.col("consumo_total").cast("double").alias("consumo_total"), "consumo_prom", "registros",
    )


@query("""
SELECT * FROM (VALUES ('anio', true), ('bimestre', true), ('alcaldia', false), ('colonia', false), ('consumo_total', true), ('consumo_prom_dom', true))
  AS v(column_name, is_numeric) WHERE EXISTS (SELECT 1 FROM mart)""")
def numeric_columns(c):
    head = c.mart.select(
        "anio", "bimestre", "alcaldia", "colonia", "consumo_total",
        F.round("consumo_prom_dom", 2).alias("consumo_prom_dom"),
    )
    return relational.numeric_columns(head, ["anio", "bimestre", "alcaldia", "colonia", "consumo_total"])


@query("""
SELECT COUNT(CASE WHEN consumo_prom_dom IS NULL THEN 1 END) AS n FROM (
  SELECT consumo_prom_dom FROM mart ORDER BY anio, bimestre, alcaldia, colonia, fecha, indice_des LIMIT 100)""")
def head_nulls(c):
    return quality.head_nulls(c.mart, marts.mart_order(), "consumo_prom_dom")


@query(f"""
SELECT alcaldia, colonia, CAST(COUNT(*) AS BIGINT) AS fuera FROM stg_consumo
WHERE NOT (latitud BETWEEN {AREA.lat_min} AND {AREA.lat_max} AND longitud BETWEEN {AREA.lon_min} AND {AREA.lon_max})
GROUP BY alcaldia, colonia""")
def readings_outside_box(c):
    outside = c.star.readings.filter(~in_bbox(F.col("latitud"), F.col("longitud")))
    return outside.groupBy("alcaldia", "colonia").agg(F.count("*").alias("fuera"))


@query("""
SELECT anio, alcaldia, COUNT(*) AS n, COUNT(consumo_prom_dom) AS con_dom, CAST(SUM(CAST(consumo_total AS DECIMAL(18,2))) AS DOUBLE) AS total,
  MIN(CAST(fecha AS VARCHAR)) AS desde FROM mart WHERE latitud IS NOT NULL GROUP BY anio, alcaldia""")
def mart_through_json(c):
    """The export, validated and written as JSON lines, compressed, read back."""
    s = c.star
    placed = c.mart.filter(F.col("latitud").isNotNull())
    path = shared_path(c.spark, "export")
    corr = marts.correlation(s.fact, s.fact_climate, s.dim_time)
    problems = writers.export_mart(placed, corr, path, compression="gzip")
    if problems:
        raise quality.QualityError("; ".join(problems))
    back = readers.read_mart_rows(c.spark, f"{path}/consumo_colonia", schemas.MART_ROW)
    return back.groupBy("anio", "alcaldia").agg(
        F.count("*").alias("n"),
        F.count("consumo_prom_dom").alias("con_dom"),
        F.sum(F.col("consumo_total").cast("decimal(18,2)")).cast("double").alias("total"),
        F.min("fecha").alias("desde"),
    )
