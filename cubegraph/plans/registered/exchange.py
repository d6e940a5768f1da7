"""Exchange formats and small relational helpers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubegraph.functions import numbers, text
from cubegraph.functions.geo import Box
from cubegraph.operators import dims, relational, triples
from cubegraph.plans.registered.base import Query, registrar
from cubegraph.session import shared_path
from cubegraph.sources import readers, writers
from cubegraph.sources.schemas import POLYGON_NAMES

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


@query("""
SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name
FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, * FROM customer)""")
def names_through_text_csv(c):
    """Customers by header names, with both null tokens, padded and not."""
    token = F.when(F.col("c_custkey") % 2 == 0, F.lit("NA")).otherwise(F.lit(" NA "))
    rows = c.table("customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_mktsegment") == "BUILDING", token).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("c_name"),
    )
    path = shared_path(c.spark, "customers-csv")
    writers.write_csv(rows, path)
    back = readers.read_csv_text(c.spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", "c_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS o_totalprice, o_orderstatus FROM orders""")
def orders_through_coerced_csv(c):
    """Orders whose amount is a number or not: what does not parse becomes null."""
    rows = c.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        "o_orderstatus",
    )
    path = shared_path(c.spark, "orders-csv")
    writers.write_csv(rows, path)
    return readers.read_csv_coerced(c.spark, path, {"o_orderkey": "long", "o_totalprice": "double"})


@query("""
SELECT COALESCE(NULLIF(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, ''), n_name || '?') AS nombre, '{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']}' AS geometry
FROM nation""")
def polygons_through_geojson(c):
    """Nations as features of one document: the first name attribute that is not empty counts."""
    first, second = POLYGON_NAMES[:2]
    name = F.col("n_name")
    feature = F.struct(
        F.struct(
            F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(name).alias(first),
            F.concat(name, F.lit("?")).alias(second),
        ).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates")).alias("geometry"),
    )
    document = c.table("nation").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    path = shared_path(c.spark, "polygons")
    document.write.text(path)  # a document of the table of nations, which is one by nature
    return readers.read_geojson(c.spark, path)


@query("SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS latitud, CAST(NULL AS VARCHAR) AS nota FROM region")
def columns_added(c):
    """Missing columns are added as nulls; one that is there stays."""
    wanted = c.spark.createDataFrame([], "r_name string, latitud double, nota string").schema
    return relational.ensure_columns(c.table("region").select("r_regionkey", "r_name"), wanted)


@query("""
SELECT c_custkey, LOWER(c_mktsegment) IN ('building', 'household') AS miembro FROM customer""")
def segment_members(c):
    """Membership in a closed list of names, whatever their case, accents and padding."""
    return c.table("customer").select(
        "c_custkey", text.is_member(F.concat(F.lit("  "), F.col("c_mktsegment")), ["Búilding ", "household"]).alias("miembro")
    )


@query("""
SELECT u.id_ubicacion, u.colonia, CAST(SUM(f.consumo_total) AS DOUBLE) AS total
FROM dim_ubicacion u JOIN fact_consumo_agua f USING (id_ubicacion) GROUP BY u.id_ubicacion, u.colonia""")
def units_with_totals(c):
    """Units and their totals, joined under the assertion that neither side repeats a key."""
    totals = c.rollup.units().groupBy("id_ubicacion").agg(F.sum("suma_consumo_total").cast("double").alias("total"))
    return relational.join_one_to_one(c.star.dim_location.select("id_ubicacion", "colonia"), totals, ["id_ubicacion"])


@query("""
SELECT o_orderkey, COALESCE(NULLIF(CASE WHEN o_orderpriority LIKE '4%' THEN '' ELSE o_orderpriority END, ''), NULLIF(o_orderstatus, 'F'), '') AS etiqueta,
  CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 END AS rango FROM orders""")
def labels_and_ranks(c):
    """The first label that is there, and the ordinal rank of a level."""
    level = F.col("o_orderpriority")
    return c.table("orders").select(
        "o_orderkey",
        text.first_present(F.when(~level.startswith("4"), level).otherwise(F.lit("")), F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("etiqueta"),
        numbers.ordinal_rank(level, {"1-URGENT": 3, "3-MEDIUM": 2, "5-LOW": 1}).alias("rango"),
    )


@query("""
SELECT s.id_obs, printf('%.2f', COALESCE(CAST(s.consumo_total AS DOUBLE), 0)) AS total, printf('%.2f', COALESCE(s.consumo_prom, 0)) AS promedio FROM aggobs s""")
def two_decimal_texts(c):
    """Measures of the reduced graph's observations as the literal texts it holds."""
    g = c.reduced
    subject = F.regexp_extract("s", r"/(\d+)$", 1).cast("long").alias("id_obs")

    def texts(predicate: str, name: str):
        rows = g.rows(p=predicate).filter("number IS NOT NULL").select("s", "o")
        named = g.texts(g.texts(rows, "s"), "o", form="number").filter(F.col("s").contains("/aggobs/"))
        return named.select(subject, F.col("o").alias(name))

    return texts("agua:totalConsumption", "total").join(texts("agua:averageConsumption", "promedio"), "id_obs")


#: A box that leaves some units without a coordinate.
NARROW = Box(19.04, 19.30, -99.36, -99.10)


@query(f"""
WITH lugar AS (SELECT u.id_ubicacion, COUNT(s.latitud) AS dentro FROM dim_ubicacion u LEFT JOIN stg_consumo s ON s.alcaldia = u.alcaldia AND s.colonia = u.colonia
    AND s.latitud BETWEEN {NARROW.lat_min} AND {NARROW.lat_max} AND s.longitud BETWEEN {NARROW.lon_min} AND {NARROW.lon_max} GROUP BY u.id_ubicacion)
SELECT p, COUNT(*) AS n, COUNT(DISTINCT o) AS valores FROM (
  SELECT 'hasNoGeometry' AS p, 'true' AS o FROM lugar WHERE dentro = 0
  UNION ALL SELECT 'hasGeometry', CAST(id_ubicacion AS VARCHAR) FROM lugar WHERE dentro > 0
  UNION ALL SELECT 'label', colonia FROM dim_ubicacion) GROUP BY p""")
def units_without_geometry(c):
    """Features of units of which some have no reading in a narrow box: these are flagged, the others have a geometry."""
    located = dims.attach_centroids(c.star.dim_location, dims.centroids(c.star.readings, NARROW))
    graph = triples.materialise([triples.place_map(located)])
    named = graph.withColumn("p", text.last_segment(F.col("p"))).filter(F.col("p").isin("hasNoGeometry", "hasGeometry", "label"))
    return named.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("valores"))
