"""Registration, shared stored tables and shared SQL of the queries."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cubegraph.functions.geo import KM_PER_DEGREE, RADIUS_KM
from cubegraph.operators import marts
from cubegraph.operators.facts import MEASURES
from cubegraph.operators.names import NameIndex, index_names
from cubegraph.operators.ordering import OrderedRows, store_ordered
from cubegraph.operators.rollup import RollupState
from cubegraph.operators.termstore import MappedGraph, StoredGraph
from cubegraph.plans import graphs
from cubegraph.plans.warehouse import Star, load_star
from cubegraph.session import drop_stored, materialise_table, tune
from cubegraph.sources.reaimed import read_table


def loaded(build: Callable[[Context], Any]) -> property:
    """A table of a context: loaded on first use and once, whichever thread asks."""

    def get(self: Context):
        with self.loading:
            if build.__name__ not in self.tables:
                self.tables[build.__name__] = build(self)
            return self.tables[build.__name__]

    return property(get, doc=build.__doc__)


class Context:
    """Tables derived from one data folder as it is at first use, loaded then and kept stored until ``close_all``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables: dict[str, Any] = {}
        self.loading = threading.RLock()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @loaded
    def star(self) -> Star:
        return load_star(self.spark, self.sf_dir)

    @loaded
    def mart(self) -> DataFrame:
        s = self.star
        return materialise_table(
            marts.build_mart(s.fact, s.dim_time, s.dim_location, s.dim_level), "mart"
        )

    @loaded
    def rollup(self) -> RollupState:
        state = RollupState(self.spark)
        state.merge(self.star.fact, self.star.dim_time, "first")
        return state

    @loaded
    def ordered(self) -> OrderedRows:
        """The rows that are paged through, in their order."""
        s = self.star
        rows = marts.retrieval_rows(s.fact, s.dim_time, s.dim_location, s.dim_level)
        return store_ordered(rows, marts.retrieval_order(), "retrieval")

    @loaded
    def names(self) -> NameIndex:
        return index_names(self.star.dim_location, "id_ubicacion", "colonia", "unit-names")

    @loaded
    def edges(self) -> DataFrame:
        """Pairs within the radius; they are made anew by everything that reads them."""
        return graphs.radius_edges(self.star)

    @loaded
    def distances(self) -> DataFrame:
        return graphs.radius_distances(self.star)

    @loaded
    def nearest(self) -> DataFrame:
        return graphs.nearest_edges(self.star)

    @loaded
    def observations(self) -> DataFrame:
        """The numbered observations of the reduced graph."""
        return graphs.observations(self.star)

    @loaded
    def graph(self) -> StoredGraph:
        return graphs.full_graph(self.star, self.edges, self.distances)

    @loaded
    def graph_without_edges(self) -> StoredGraph:
        return graphs.graph_without_edges(self.star)

    @loaded
    def mapped(self) -> MappedGraph:
        return graphs.mapped_graph(self.star, lambda: self.edges, lambda: self.distances)

    @loaded
    def reduced(self) -> MappedGraph:
        return graphs.reduced_graph(self.star, lambda: self.observations, lambda: self.nearest)

    @loaded
    def faulty(self) -> MappedGraph:
        return graphs.faulty_graph(self.reduced)


_CONTEXTS: dict[tuple[str, str], Context] = {}
_OPENING = threading.RLock()


def context(spark: SparkSession, sf_dir: str) -> Context:
    """The context of one application and folder; its tables are loaded once."""
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
    with _OPENING:
        if key not in _CONTEXTS:
            _CONTEXTS[key] = Context(tune(spark), key[1])
        return _CONTEXTS[key]


def close_all(spark: SparkSession) -> int:
    """End this application's contexts and delete all tables it stored; the next query reads its sources anew."""
    app = spark.sparkContext.applicationId
    with _OPENING:
        for key in [k for k in _CONTEXTS if k[0] == app]:
            del _CONTEXTS[key]
        return drop_stored(spark)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Context], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(context(spark, sf_dir))


def registrar(queries: dict[str, Query]):
    """Decorator that files a function of a context under its name, with its SQL."""

    def register(sql: str | None = None):
        def add(build):
            text = with_tables(sql) if sql else None
            queries[build.__name__] = Query(build.__name__, build, text)
            return build

        return add

    return register


# The derived tables in SQL, in terms of the given ones and of each other.
TABLES = {
    "stg_consumo": """
SELECT CAST(l.l_shipdate AS DATE) AS fecha_referencia,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS consumo_total,
  CAST(l.l_quantity AS DECIMAL(18,2)) AS consumo_prom,
  CASE WHEN l.l_returnflag='A' THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS consumo_total_dom,
  CASE WHEN l.l_returnflag='A' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END AS consumo_prom_dom,
  CASE WHEN l.l_returnflag='N' THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS consumo_total_no_dom,
  CASE WHEN l.l_returnflag='N' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END AS consumo_prom_no_dom,
  CASE WHEN l.l_returnflag='R' THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS consumo_total_mixto,
  CASE WHEN l.l_returnflag='R' THEN CAST(l.l_quantity AS DECIMAL(18,2)) END AS consumo_prom_mixto,
  NULLIF(o.o_orderpriority,'4-NOT SPECIFIED') AS indice_des,
  CASE WHEN l.l_partkey % 331 = 0 THEN NULL ELSE c.c_name END AS colonia,
  CASE WHEN l.l_partkey % 331 = 0 THEN NULL ELSE n.n_name END AS alcaldia,
  CAST(19040000 + ((c.c_nationkey*1117)%5000 + (c.c_custkey*7919)%600)*100 + (l.l_linenumber-4)*100 AS DOUBLE)/CAST(1000000 AS DOUBLE) AS latitud,
  CAST(-99360000 + ((c.c_nationkey*2311)%3600 + (c.c_custkey*c.c_custkey*13+c.c_custkey*31)%600)*100 + (l.l_linenumber-4)*100 AS DOUBLE)/CAST(1000000 AS DOUBLE) AS longitud
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
  JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey""",
    "stg_clima": """
SELECT o_orderdate AS fecha_hora,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)/CAST(15000 AS DOUBLE) AS temperatura,
  CAST(o_custkey % 101 AS INT) AS humedad_relativa,
  CASE WHEN o_orderstatus='P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS lluvia
FROM orders""",
    "dim_tiempo": """
SELECT CAST(dense_rank() OVER (ORDER BY dia_serie) AS BIGINT) AS id_tiempo, dia_serie AS fecha, CAST(year(dia_serie) AS INTEGER) AS anio,
  CAST(month(dia_serie) AS INTEGER) AS mes, CAST(day(dia_serie) AS INTEGER) AS dia, CAST((month(dia_serie) + 1) // 2 AS INTEGER) AS bimestre
FROM (SELECT CAST(fecha_hora AS DATE) AS dia_serie FROM stg_clima GROUP BY 1)""",
    "centroides": """
SELECT alcaldia, colonia,
  CAST(CAST(SIGN(sa) * ((2*ABS(sa) + n) // (2*n)) AS DECIMAL(12,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(9,6)) AS latitud,
  CAST(CAST(SIGN(so) * ((2*ABS(so) + n) // (2*n)) AS DECIMAL(12,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(9,6)) AS longitud
FROM (SELECT alcaldia, colonia, CAST(SUM(CAST(ROUND(latitud*1000000) AS BIGINT)) AS BIGINT) AS sa,
    CAST(SUM(CAST(ROUND(longitud*1000000) AS BIGINT)) AS BIGINT) AS so, COUNT(*) AS n
  FROM stg_consumo
  WHERE latitud BETWEEN 19.04 AND 19.60 AND longitud BETWEEN -99.36 AND -98.94
  GROUP BY alcaldia, colonia)""",
    "dim_ubicacion": """
SELECT u.id_ubicacion, u.alcaldia, u.colonia, c.latitud, c.longitud
FROM (SELECT row_number() OVER (ORDER BY alcaldia, colonia) AS id_ubicacion, alcaldia, colonia
  FROM (SELECT DISTINCT alcaldia, colonia FROM stg_consumo WHERE colonia IS NOT NULL)) u
LEFT JOIN centroides c ON u.alcaldia = c.alcaldia AND u.colonia = c.colonia""",
    "dim_indice_des": """
SELECT row_number() OVER (ORDER BY indice_des) AS id_indice_des, indice_des
FROM (SELECT DISTINCT indice_des FROM stg_consumo WHERE indice_des IS NOT NULL)""",
    # A reading is a fact if its day, unit and level are known; the keys come from the natural joins on their names.
    "fact_consumo_agua": f"""
SELECT id_tiempo, id_ubicacion, id_indice_des, {", ".join(MEASURES)}
FROM stg_consumo NATURAL JOIN dim_indice_des
  NATURAL JOIN (SELECT id_ubicacion, alcaldia, colonia FROM dim_ubicacion)
  NATURAL JOIN (SELECT id_tiempo, fecha AS fecha_referencia FROM dim_tiempo)""",
    "fact_clima": """
SELECT t.id_tiempo, MAX(s.temperatura) AS temp_maxima, MIN(s.temperatura) AS temp_minima,
  AVG(s.temperatura) AS temp_promedio, AVG(s.humedad_relativa) AS humedad_promedio, SUM(s.lluvia) AS lluvia_total
FROM stg_clima s JOIN dim_tiempo t ON CAST(s.fecha_hora AS DATE) = t.fecha GROUP BY t.id_tiempo""",
    # Fixed formula: kilometres per degree times the length of (dy, dx cos(latitude of the origin)), in whole micro-degrees.
    "distancias": f"""
SELECT * FROM (
  SELECT a.id_ubicacion AS id_origen, b.id_ubicacion AS id_vecino, CAST({KM_PER_DEGREE} AS DOUBLE) * sqrt(
    (CAST(a.y - b.y AS DOUBLE) / 1e6) * (CAST(a.y - b.y AS DOUBLE) / 1e6)
    + (CAST(a.x - b.x AS DOUBLE) / 1e6 * a.k) * (CAST(a.x - b.x AS DOUBLE) / 1e6 * a.k)) AS distancia_km
  FROM micro a JOIN micro b ON a.id_ubicacion <> b.id_ubicacion)
WHERE distancia_km <= {RADIUS_KM}""",
    "micro": """
SELECT id_ubicacion, CAST(latitud * 1000000 AS BIGINT) AS y, CAST(longitud * 1000000 AS BIGINT) AS x,
  cos(radians(CAST(latitud AS DOUBLE))) AS k
FROM dim_ubicacion WHERE latitud IS NOT NULL AND longitud IS NOT NULL""",
    "vecinos": """
SELECT id_origen, id_vecino, distancia_km FROM (
  SELECT *, row_number() OVER (PARTITION BY id_origen ORDER BY distancia_km, id_vecino) AS r FROM distancias)
WHERE r <= 6""",
    "mart": """
WITH grupo AS (SELECT id_tiempo, id_ubicacion, id_indice_des,
    SUM(consumo_total) AS consumo_total, CASE WHEN COUNT(consumo_prom) > 0 THEN CAST(SUM(consumo_prom) AS DOUBLE) / COUNT(consumo_prom) END AS consumo_prom,
    SUM(consumo_total_dom) AS consumo_total_dom, CASE WHEN COUNT(consumo_prom_dom) > 0 THEN CAST(SUM(consumo_prom_dom) AS DOUBLE) / COUNT(consumo_prom_dom) END AS consumo_prom_dom,
    SUM(consumo_total_mixto) AS consumo_total_mixto, CASE WHEN COUNT(consumo_prom_mixto) > 0 THEN CAST(SUM(consumo_prom_mixto) AS DOUBLE) / COUNT(consumo_prom_mixto) END AS consumo_prom_mixto,
    SUM(consumo_total_no_dom) AS consumo_total_no_dom, CASE WHEN COUNT(consumo_prom_no_dom) > 0 THEN CAST(SUM(consumo_prom_no_dom) AS DOUBLE) / COUNT(consumo_prom_no_dom) END AS consumo_prom_no_dom
  FROM fact_consumo_agua GROUP BY id_tiempo, id_ubicacion, id_indice_des)
SELECT * EXCLUDE (id_tiempo, id_ubicacion, id_indice_des, mes, dia) FROM grupo NATURAL JOIN dim_tiempo NATURAL JOIN dim_ubicacion NATURAL JOIN dim_indice_des""",
    "correlacion": """
WITH agua AS (SELECT id_tiempo, SUM(consumo_total) AS s FROM fact_consumo_agua GROUP BY id_tiempo),
consumo AS (SELECT anio, bimestre, SUM(s) AS total_agua FROM agua NATURAL JOIN dim_tiempo GROUP BY anio, bimestre),
tiempo AS (SELECT anio, bimestre, round(avg(temp_promedio), 2) AS temp_promedio, COUNT(*) FILTER (temp_maxima >= 28) AS dias_ola_calor,
    COUNT(*) FILTER (temp_minima <= 10) AS dias_frio, SUM(lluvia_total) AS total_lluvia
  FROM fact_clima NATURAL JOIN dim_tiempo GROUP BY anio, bimestre)
SELECT anio, bimestre, total_agua, temp_promedio, dias_ola_calor, dias_frio, total_lluvia FROM consumo NATURAL JOIN tiempo""",
    "aggobs": """
SELECT row_number() OVER (ORDER BY id_ubicacion, id_tiempo, id_indice_des) AS id_obs, *
FROM (SELECT id_ubicacion, id_tiempo, id_indice_des, SUM(consumo_total) AS consumo_total,
    CAST(SUM(consumo_prom) AS DOUBLE)/NULLIF(COUNT(consumo_prom),0) AS consumo_prom,
    SUM(consumo_total_dom) AS consumo_total_dom, SUM(consumo_total_no_dom) AS consumo_total_no_dom,
    SUM(consumo_total_mixto) AS consumo_total_mixto, COUNT(*) AS registros
  FROM fact_consumo_agua GROUP BY id_ubicacion, id_tiempo, id_indice_des)""",
    "totales": """
SELECT alcaldia, colonia, id_ubicacion, total, mu, sigma, ABS(total-mu)/(sigma+1e-9) AS score, (total-mu)/(sigma+1e-9) AS z
FROM (SELECT u.alcaldia, u.colonia, u.id_ubicacion, CAST(SUM(f.consumo_total) AS DOUBLE) AS total
    FROM fact_consumo_agua f JOIN dim_ubicacion u USING (id_ubicacion) GROUP BY u.alcaldia, u.colonia, u.id_ubicacion) x
  JOIN (SELECT alcaldia, AVG(total) AS mu, STDDEV_POP(total) AS sigma
    FROM (SELECT u.alcaldia, u.colonia, CAST(SUM(f.consumo_total) AS DOUBLE) AS total
      FROM fact_consumo_agua f JOIN dim_ubicacion u USING (id_ubicacion) GROUP BY u.alcaldia, u.colonia) y
    GROUP BY alcaldia) g USING (alcaldia)""",
    "panel": """
SELECT u.id_ubicacion AS unit_id, t.anio, t.bimestre, u.alcaldia, u.colonia, SUM(f.consumo_total) AS consumo
FROM fact_consumo_agua f JOIN dim_ubicacion u USING (id_ubicacion) JOIN dim_tiempo t USING (id_tiempo)
GROUP BY u.id_ubicacion, t.anio, t.bimestre, u.alcaldia, u.colonia""",
}


def with_tables(sql: str) -> str:
    """Prepend the derived tables a statement names, each after those it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
