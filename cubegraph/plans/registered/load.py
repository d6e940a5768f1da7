"""Queries about the load: dimensions, facts, audits and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.functions import dates
from cubegraph.operators import dims, facts, marts, quality, relational
from cubegraph.plans.registered.base import Query, registrar
from cubegraph.session import shared_path
from cubegraph.sources import readers, schemas, writers

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


def _doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("""
SELECT anio, bimestre, CAST(total_agua AS DOUBLE) AS total_agua, temp_promedio, dias_ola_calor, dias_frio,
  CAST(total_lluvia AS DOUBLE) AS total_lluvia FROM correlacion ORDER BY anio, bimestre""")
def flagship_correlation(c):
    s = c.star
    return _doubles(
        marts.correlation(s.fact, s.fact_climate, s.dim_time), "total_agua", "total_lluvia"
    )


@query("""
SELECT CAST(CAST(fecha_hora AS DATE) AS VARCHAR) AS fecha, ROUND(MAX(temperatura),6) AS temp_maxima,
  ROUND(MIN(temperatura),6) AS temp_minima, ROUND(AVG(temperatura),9) AS temp_promedio,
  CAST(SUM(humedad_relativa) AS DOUBLE)/COUNT(humedad_relativa) AS humedad_promedio,
  CAST(SUM(lluvia) AS DOUBLE) AS lluvia_total
FROM stg_clima GROUP BY CAST(fecha_hora AS DATE)""")
def daily_climate_rollup(c):
    return facts.daily_rollup(c.star.climate).select(
        dates.iso_date(F.col("fecha")).alias("fecha"),
        F.round("temp_maxima", 6).alias("temp_maxima"),
        F.round("temp_minima", 6).alias("temp_minima"),
        F.round("temp_promedio", 9).alias("temp_promedio"),
        "humedad_promedio",
        F.col("lluvia_total").cast("double").alias("lluvia_total"),
    )


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, MAX(value) AS temp_maxima, MIN(value) AS temp_minima,
  ROUND(AVG(value),9) AS temp_promedio, CAST(SUM(k) AS DOUBLE)/COUNT(k) AS humedad_promedio,
  CAST(SUM(CASE WHEN event_type='error' THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS lluvia_total
FROM (SELECT ts, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
GROUP BY CAST(ts AS DATE)""")
def daily_event_rollup(c):
    value = F.col("value")
    series = c.table("events").select(
        F.col("ts").alias("fecha_hora"),
        value.alias("temperatura"),
        F.get_json_object("props", "$.k").cast("int").alias("humedad_relativa"),
        F.when(F.col("event_type") == "error", value.cast("decimal(18,2)"))
        .otherwise(F.lit(0).cast("decimal(18,2)"))
        .alias("lluvia"),
    )
    return facts.daily_rollup(series).select(
        dates.iso_date(F.col("fecha")).alias("fecha"),
        "temp_maxima",
        "temp_minima",
        F.round("temp_promedio", 9).alias("temp_promedio"),
        "humedad_promedio",
        F.col("lluvia_total").cast("double").alias("lluvia_total"),
    )


@query("SELECT id_tiempo, CAST(fecha AS VARCHAR) AS fecha, anio, mes, dia, bimestre FROM dim_tiempo")
def dim_time(c):
    return c.star.dim_time.withColumn("fecha", dates.iso_date(F.col("fecha")))


@query("""
SELECT id_ubicacion, alcaldia, colonia, CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud
FROM dim_ubicacion""")
def dim_location(c):
    return _doubles(c.star.dim_location, "latitud", "longitud")


@query("SELECT id_indice_des, indice_des FROM dim_indice_des")
def dim_level(c):
    return c.star.dim_level


@query("""
SELECT i.indice_des, COUNT(*) AS n, COUNT(DISTINCT f.id_tiempo) AS dias, COUNT(DISTINCT f.id_ubicacion) AS unidades,
  CAST(SUM(f.consumo_total) AS DOUBLE) AS total, COUNT(f.consumo_prom_dom) AS con_dom
FROM fact_consumo_agua f JOIN dim_indice_des i USING (id_indice_des) GROUP BY i.indice_des""")
def fact_load_counts(c):
    """The load itself: staging joined to the dimensions, counted per level."""
    s = c.star
    loaded = facts.build_fact_consumption(s.readings, s.dim_time, s.dim_location, s.dim_level)
    # One row per (level, unit, day) before days and units are counted as sets.
    reduced = loaded.groupBy("id_indice_des", "id_ubicacion", "id_tiempo").agg(
        F.count("*").alias("n"), F.sum("consumo_total").alias("total"), F.count("consumo_prom_dom").alias("con_dom")
    )
    return (
        facts.star(reduced, (s.dim_level, "id_indice_des"))
        .groupBy("indice_des")
        .agg(
            F.sum("n").alias("n"),
            F.count_distinct("id_tiempo").alias("dias"),
            F.count_distinct("id_ubicacion").alias("unidades"),
            F.sum("total").cast("double").alias("total"),
            F.sum("con_dom").alias("con_dom"),
        )
    )


@query("""
SELECT id_tiempo AS id_fact_clima, id_tiempo, ROUND(temp_maxima,6) AS temp_maxima, ROUND(temp_minima,6) AS temp_minima,
  ROUND(temp_promedio,9) AS temp_promedio, ROUND(humedad_promedio,9) AS humedad_promedio,
  CAST(lluvia_total AS DOUBLE) AS lluvia_total FROM fact_clima""")
def fact_climate(c):
    return c.star.fact_climate.select(
        "id_fact_clima",
        "id_tiempo",
        F.round("temp_maxima", 6).alias("temp_maxima"),
        F.round("temp_minima", 6).alias("temp_minima"),
        F.round("temp_promedio", 9).alias("temp_promedio"),
        F.round("humedad_promedio", 9).alias("humedad_promedio"),
        F.col("lluvia_total").cast("double").alias("lluvia_total"),
    )


_AUDIT_TAIL = """
lines AS (
  SELECT criterion, SUM(CASE WHEN r.reason = criterion THEN r.n ELSE 0 END) AS records
  FROM (VALUES {names}, ('Loaded into the fact table')) AS v(criterion) CROSS JOIN (SELECT reason, COUNT(*) AS n FROM reasons GROUP BY reason) r
  GROUP BY criterion),
rows_ AS (
  SELECT criterion, CAST(records AS BIGINT) AS records FROM lines
  UNION ALL SELECT 'Total discarded', CAST(SUM(records) AS BIGINT) FROM lines WHERE criterion <> 'Loaded into the fact table'
  UNION ALL SELECT 'Source records read', CAST(SUM(records) AS BIGINT) FROM lines)
SELECT criterion, records, ROUND(100.0::DOUBLE * records / (SELECT SUM(records) FROM lines), 2) AS pct FROM rows_"""


@query("""WITH reasons AS (
  SELECT CASE WHEN s.colonia IS NULL OR s.alcaldia IS NULL THEN 'Unmatched territorial label'
    WHEN s.indice_des IS NULL THEN 'Missing development index'
    WHEN t.fecha IS NULL THEN 'Date absent from dim_tiempo' ELSE 'Loaded into the fact table' END AS reason
  FROM stg_consumo s LEFT JOIN dim_tiempo t ON s.fecha_referencia = t.fecha),""" + _AUDIT_TAIL.format(
    names="('Unmatched territorial label'), ('Missing development index'), ('Date absent from dim_tiempo')"))
def loss_audit(c):
    return quality.load_audit(c.star.readings, c.star.dim_time)


@query("""WITH reasons AS (
  SELECT CASE WHEN consumo_total IS NULL THEN 'Missing or non-numeric measure'
    WHEN NOT (latitud BETWEEN 19.04 AND 19.60 AND longitud BETWEEN -99.36 AND -98.94) THEN 'Null or out-of-range coordinates'
    WHEN colonia IS NULL OR alcaldia IS NULL THEN 'Unmatched territorial label'
    WHEN fecha_referencia IS NULL THEN 'Unparseable reading date' ELSE 'Loaded into the fact table' END AS reason
  FROM stg_consumo),""" + _AUDIT_TAIL.format(
    names="('Missing or non-numeric measure'), ('Null or out-of-range coordinates'), ('Unmatched territorial label'), ('Unparseable reading date')"))
def cleaning_audit(c):
    return quality.cleaning_audit(c.star.readings)


@query("""
SELECT 'fact_consumo_agua' AS tabla, COUNT(*) AS n FROM fact_consumo_agua
UNION ALL SELECT 'dim_ubicacion', COUNT(*) FROM dim_ubicacion
UNION ALL SELECT 'dim_tiempo', COUNT(*) FROM dim_tiempo
UNION ALL SELECT 'dim_indice_des', COUNT(*) FROM dim_indice_des
UNION ALL SELECT 'fact_clima', COUNT(*) FROM fact_clima""")
def cardinalities(c):
    s = c.star
    return quality.cardinalities(
        {
            "fact_consumo_agua": s.fact,
            "dim_ubicacion": s.dim_location,
            "dim_tiempo": s.dim_time,
            "dim_indice_des": s.dim_level,
            "fact_clima": s.fact_climate,
        }
    )


@query("""
SELECT CAST(MIN(fecha_referencia) AS VARCHAR) AS desde, CAST(MAX(fecha_referencia) AS VARCHAR) AS hasta,
  COUNT(DISTINCT fecha_referencia) AS dias FROM stg_consumo""")
def reading_dates(c):
    return quality.date_range(c.star.readings, "fecha_referencia").select(
        dates.iso_date(F.col("desde")).alias("desde"), dates.iso_date(F.col("hasta")).alias("hasta"), "dias"
    )


@query("""
SELECT fecha_referencia_txt AS fecha, COUNT(*) AS n FROM (
  SELECT CAST(s.fecha_referencia AS VARCHAR) AS fecha_referencia_txt FROM stg_consumo s
  WHERE s.fecha_referencia IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_tiempo t WHERE t.fecha = s.fecha_referencia))
GROUP BY fecha_referencia_txt""")
def orphans(c):
    """Readings whose day the time dimension lacks, per day."""
    days = c.star.dim_time.withColumnRenamed("fecha", "fecha_referencia")
    lost = quality.orphans(c.star.readings, days, "fecha_referencia")
    return lost.groupBy(dates.iso_date(F.col("fecha_referencia")).alias("fecha")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def duplicates(c):
    return quality.duplicates(c.table("lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT CAST(fecha AS VARCHAR) AS fecha, anio, bimestre, CASE WHEN anio < 1997 THEN 'stored' ELSE 'new' END AS origen
FROM dim_tiempo""")
def insert_ignore_dates(c):
    """Days already stored stay as they are; only unknown ones are added, once."""
    days = dims.calendar_days(c.star.climate).select("fecha", "anio", "bimestre")
    stored = days.filter(F.col("anio") < 1997).withColumn("origen", F.lit("stored"))
    offered = days.unionByName(days).withColumn("origen", F.lit("new"))
    return relational.insert_ignore(stored, offered, "fecha").withColumn(
        "fecha", dates.iso_date(F.col("fecha"))
    )


@query("""
SELECT alcaldia, COUNT(*) AS n, COUNT(indice_des) AS con_indice, COUNT(consumo_prom_dom) AS con_dom,
  CAST(SUM(consumo_total) AS DOUBLE) AS total, CAST(MIN(fecha_referencia) AS VARCHAR) AS desde, ROUND(MAX(latitud), 6) AS latitud
FROM stg_consumo GROUP BY alcaldia""")
def readings_through_csv(c):
    """Readings written as delimited text with the null token and read by the declared schema."""
    names = schemas.CONSUMPTION.names
    token = F.lit("NA")
    readings = c.star.readings.withColumns(
        {"anio": F.year("fecha_referencia"), "bimestre": dates.bimester(F.month("fecha_referencia"))}
    )
    text = readings.select(*[F.coalesce(F.col(n).cast("string"), token).alias(n) for n in names])
    path = shared_path(c.spark, "readings-csv")
    writers.write_csv(text, path)
    back = readers.read_csv(c.spark, path, schemas.CONSUMPTION)
    return back.groupBy("alcaldia").agg(
        F.count("*").alias("n"),
        F.count("indice_des").alias("con_indice"),
        F.count("consumo_prom_dom").alias("con_dom"),
        F.sum("consumo_total").cast("double").alias("total"),
        dates.iso_date(F.min("fecha_referencia")).alias("desde"),
        F.round(F.max("latitud").cast("double"), 6).alias("latitud"),
    )


_QUOTED = r"""
SELECT colonia, COUNT(*) AS n, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM (
  SELECT alcaldia || CASE EXTRACT(DAY FROM fecha_referencia) % 4 WHEN 0 THEN ' "ROSAL", A' WHEN 1 THEN chr(10) || 'B' WHEN 2 THEN ' C' || chr(92) ELSE ' "D"' END AS colonia, consumo_total
  FROM stg_consumo WHERE alcaldia IS NOT NULL) GROUP BY colonia"""


def _quoted(c) -> DataFrame:
    """Readings as text, with quotes, commas, backslashes and line breaks in their names."""
    day = F.dayofmonth("fecha_referencia") % 4
    ending = F.when(day == 0, ' "ROSAL", A').when(day == 1, "\nB").when(day == 2, " C\\").otherwise(' "D"')
    names = schemas.CONSUMPTION.names
    readings = c.star.readings.filter(F.col("alcaldia").isNotNull()).withColumns(
        {
            "colonia": F.concat("alcaldia", ending),
            "anio": F.year("fecha_referencia"),
            "bimestre": dates.bimester(F.month("fecha_referencia")),
        }
    )
    return readings.select(*[F.coalesce(F.col(n).cast("string"), F.lit("NA")).alias(n) for n in names])


def _by_name(back: DataFrame) -> DataFrame:
    return back.groupBy("colonia").agg(F.count("*").alias("n"), F.sum("consumo_total").cast("double").alias("total"))


@query(_QUOTED)
def readings_through_quoted_csv(c):
    """Names with quotes, commas, backslashes and line breaks survive the round trip through delimited text."""
    path = shared_path(c.spark, "quoted-csv")
    writers.write_csv(_quoted(c), path)
    return _by_name(readers.read_csv(c.spark, path, schemas.CONSUMPTION, multiline=True))


@query(_QUOTED)
def readings_through_split_csv(c):
    """The same text read by as many tasks as its files have splits, wherever these cut a quoted line break."""
    path = shared_path(c.spark, "split-csv")
    writers.write_csv(_quoted(c), path)
    return _by_name(readers.read_csv_records(c.spark, path, schemas.CONSUMPTION))


@query("""
SELECT CAST(EXTRACT(YEAR FROM fecha_hora) AS INTEGER) AS anio, COUNT(*) AS n, COUNT(lluvia) AS con_lluvia, CAST(SUM(humedad_relativa) AS BIGINT) AS humedad,
  CAST(SUM(lluvia) AS DOUBLE) AS lluvia FROM (SELECT fecha_hora, humedad_relativa, NULLIF(lluvia, 0) AS lluvia FROM stg_clima) GROUP BY 1""")
def climate_through_csv(c):
    """The sub-daily series written with its header names and read by position."""
    row = c.star.climate.select(
        F.date_format("fecha_hora", "yyyy-MM-dd'T'HH:mm").alias("fecha_hora"),
        F.col("temperatura").cast("decimal(18,6)").cast("string").alias("temperatura"),
        F.col("humedad_relativa").cast("string").alias("humedad_relativa"),
        F.coalesce(F.nullif(F.col("lluvia"), F.lit(0)).cast("string"), F.lit("NA")).alias("lluvia"),
    )
    path = shared_path(c.spark, "climate-csv")
    writers.write_csv(row.withColumnsRenamed(schemas.CLIMATE_HEADERS), path)
    back = readers.read_csv(c.spark, path, schemas.CLIMATE)
    return back.groupBy(F.year("fecha_hora").alias("anio")).agg(
        F.count("*").alias("n"),
        F.count("lluvia").alias("con_lluvia"),
        F.sum("humedad_relativa").cast("long").alias("humedad"),
        F.sum("lluvia").cast("double").alias("lluvia"),
    )


@query("""
SELECT alcaldia, colonia, CASE WHEN lote = 1 THEN 'first' ELSE 'second' END AS lote FROM (
  SELECT alcaldia, colonia, MIN(CASE WHEN EXTRACT(YEAR FROM fecha_referencia) < 1997 THEN 1 ELSE 2 END) AS lote
  FROM stg_consumo WHERE colonia IS NOT NULL GROUP BY alcaldia, colonia)""")
def append_dimension(c):
    """Two batches of units: the second adds only new ones, with keys above the first's."""
    path = shared_path(c.spark, "appended-dimension")
    units = c.star.readings.filter(F.col("colonia").isNotNull())
    early = F.year("fecha_referencia") < 1997
    key = ["alcaldia", "colonia"]
    first = writers.load_dim(units.filter(early).select(*key).distinct(), path, key, "id")
    last = first.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    both = writers.load_dim(units.select(*key).distinct(), path, key, "id")
    repeated = both.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    return both.join(repeated, "id", "left_anti").select(
        *key, F.when(F.col("id") <= last, "first").otherwise("second").alias("lote")
    )


@query("""
SELECT COUNT(*) AS n, COUNT(*) AS claves, CAST(SUM(consumo_total) AS DOUBLE) AS total FROM fact_consumo_agua""")
def append_fact(c):
    """Two batches of facts under keys that never meet."""
    path = shared_path(c.spark, "appended-fact")
    rows = c.star.fact.drop("id_fact")
    writers.load_fact(rows.filter("id_tiempo % 2 = 0"), path, "id_fact")
    both = writers.load_fact(rows.filter("id_tiempo % 2 = 1"), path, "id_fact")
    keyed = both.groupBy("id_fact").agg(F.count("*").alias("n"), F.sum("consumo_total").alias("total"))
    return keyed.agg(F.sum("n").alias("n"), F.count("*").alias("claves"), F.sum("total").cast("double").alias("total"))


@query("""
SELECT CASE WHEN id_tiempo % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, COUNT(*) AS n, COUNT(*) AS claves, CAST(SUM(consumo_total) AS DOUBLE) AS total
FROM fact_consumo_agua GROUP BY 1""")
def repeated_batch(c):
    """Two named batches, the first half written at first and the second loaded twice: every reading once, under a key of its own."""
    path = shared_path(c.spark, "batched-fact")
    rows = c.star.fact.drop("id_fact")
    even, odd = rows.filter("id_tiempo % 2 = 0"), rows.filter("id_tiempo % 2 = 1")
    for batch, part in (("even", even.filter("id_ubicacion % 2 = 0")), ("odd", odd), ("even", even), ("odd", odd)):
        stored = writers.load_fact(part, path, "id_fact", batch)
    keyed = stored.groupBy("batch", "id_fact").agg(F.count("*").alias("n"), F.sum("consumo_total").alias("total"))
    return keyed.groupBy("batch").agg(
        F.sum("n").alias("n"), F.count("*").alias("claves"), F.sum("total").cast("double").alias("total")
    )
