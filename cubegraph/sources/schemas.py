"""Declared schemas of the source files and exchange documents."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = T.DecimalType(18, 6)
COORDINATE = T.DecimalType(9, 6)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Columns of the two source files, in file order.
CONSUMPTION = _struct(
    fecha_referencia=T.DateType(),
    anio=T.IntegerType(),
    bimestre=T.IntegerType(),
    consumo_total_mixto=NUMERIC,
    consumo_prom_dom=NUMERIC,
    consumo_total_dom=NUMERIC,
    consumo_prom_mixto=NUMERIC,
    consumo_total=NUMERIC,
    consumo_prom=NUMERIC,
    consumo_prom_no_dom=NUMERIC,
    consumo_total_no_dom=NUMERIC,
    indice_des=T.StringType(),
    colonia=T.StringType(),
    alcaldia=T.StringType(),
    latitud=NUMERIC,
    longitud=NUMERIC,
)
CLIMATE = _struct(
    fecha_hora=T.TimestampNTZType(),
    temperatura=NUMERIC,
    humedad_relativa=T.IntegerType(),
    lluvia=NUMERIC,
)
# Header names of the climate file as published, by column.
CLIMATE_HEADERS = {
    "fecha_hora": "time",
    "temperatura": "temperature_2m (°C)",
    "humedad_relativa": "relative_humidity_2m (%)",
    "lluvia": "rain (mm)",
}

_MEASURES = {
    c: T.DoubleType()
    for c in (
        "consumo_total", "consumo_prom", "consumo_total_dom", "consumo_prom_dom",
        "consumo_total_mixto", "consumo_prom_mixto", "consumo_total_no_dom", "consumo_prom_no_dom",
        "latitud", "longitud",
    )
}
MART_ROW = _struct(
    anio=T.IntegerType(),
    bimestre=T.IntegerType(),
    fecha=T.StringType(),
    alcaldia=T.StringType(),
    colonia=T.StringType(),
    indice_des=T.StringType(),
    **_MEASURES,
)
CORRELATION_ROW = _struct(
    anio=T.IntegerType(),
    bimestre=T.IntegerType(),
    total_agua=T.DoubleType(),
    temp_promedio=T.DoubleType(),
    dias_ola_calor=T.LongType(),
    dias_frio=T.LongType(),
    total_lluvia=T.DoubleType(),
)
MART_DOCUMENT = _struct(
    anios=T.ArrayType(T.IntegerType()),
    bimestres=T.ArrayType(T.IntegerType()),
    alcaldias=T.ArrayType(T.StringType()),
    indices=T.ArrayType(T.StringType()),
    colonias_por_alcaldia=T.MapType(T.StringType(), T.ArrayType(T.StringType())),
    consumo_colonia=T.ArrayType(MART_ROW),
    correlacion=T.ArrayType(CORRELATION_ROW),
    generado_en=T.StringType(),
    nota=T.StringType(),
)

# Attributes that may hold a polygon's name, in order of preference.
POLYGON_NAMES = [
    "NOMGEO", "nomgeo", "nom_mun", "NOM_MUN", "alcaldia", "ALCALDIA",
    "municipio", "MUNICIPIO", "name", "NAME", "nombre",
]
