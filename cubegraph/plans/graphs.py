"""Graphs over a star: the full projection and the reduced one."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.geo import RADIUS_KM
from cubegraph.functions.text import expand
from cubegraph.operators import dims, marts, patterns, territory, triples
from cubegraph.operators.termstore import MappedGraph, StoredGraph, store_terms
from cubegraph.plans.warehouse import Star
from cubegraph.session import materialise_table
from cubegraph.sources.vocabulary import RDF_TYPE, TRIPLE_SCHEMA, iri, ref, schema_rows

_FACTS_PER_TASK = 200_000


def star_maps(star: Star, edges: DataFrame | None, distances: DataFrame | None = None) -> list[triples.TriplesMap]:
    """The maps of the full graph, without edges where they are None; ``distances`` are theirs, each of an origin once."""
    return [
        triples.observation_map(star.fact, star.dim_level),
        triples.climate_map(star.fact_climate),
        triples.feature_map(star.dim_location),
        triples.geometry_map(dims.geometry_view(star.dim_location)),
        *([] if edges is None else [triples.proximity_map(edges, distances is None)]),
        *([] if distances is None else [triples.distance_map(distances)]),
        triples.time_map(star.dim_time),
        triples.level_map(star.dim_level),
    ]


def _asks(asked: set[str] | None, stated: set[str]) -> bool:
    return asked is None or not asked.isdisjoint(map(iri, stated))


def full_triples(star: Star, edges: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """All maps plus the schema."""
    return triples.materialise(star_maps(star, edges, distances), schema_rows())


def mapped_graph(
    star: Star, edges: Callable[[], DataFrame], distances: Callable[[], DataFrame] | None = None
) -> MappedGraph:
    """The full graph, made as patterns ask for it; ``edges`` are asked for by the first pattern that needs them.

    They need not be stored: a pattern about one unit then pairs this unit alone, and counts shrink where pairs are made.
    """

    def make(asked: set[str] | None) -> DataFrame:
        near = edges() if _asks(asked, triples.EDGE_PREDICATES) else None
        apart = distances() if distances and _asks(asked, {"agua:distanceKm"}) else None
        if near is None:
            return triples.materialise(star_maps(star, None), schema_rows(), asked)
        return triples.materialise(star_maps(star, near, apart), schema_rows(), asked)

    def read_star(predicates: list[str]) -> DataFrame | None:
        if _asks(set(predicates), triples.EDGE_PREDICATES):
            return None
        return triples.mapped_star(star_maps(star, None), schema_rows(), predicates)

    return MappedGraph(star.fact.sparkSession, make, read_star)


def full_graph(star: Star, edges: DataFrame, distances: DataFrame | None = None) -> StoredGraph:
    return store_terms(full_triples(star, edges, distances), "graph")


def graph_without_edges(star: Star, radius_km: float = RADIUS_KM) -> StoredGraph:
    """The full graph but for its edges, as numbers; the dictionary also holds all distances that edges can have."""
    metres = star.fact.sparkSession.range(round(radius_km * 1000) + 1)
    kilometres = (F.col("id") / F.lit(1000)).cast("decimal(9,3)").cast("string")
    possible = metres.select(
        F.lit(iri("agua:distanceKm")).alias("s"), F.lit(iri("agua:distanceKm")).alias("p"), kilometres.alias("o"),
        F.lit("literal").alias("o_kind"), F.lit(iri("xsd:decimal")).alias("datatype"), F.lit(None).cast("string").alias("lang"),
    )
    return store_terms(triples.materialise(star_maps(star, None), schema_rows()), "graph", also=possible)


def numbered_edges(graph: StoredGraph, star: Star, radius_km: float = RADIUS_KM) -> tuple[DataFrame, DataFrame]:
    """The triples (s, p, o) that only the map of edges states, links and distances, in numbers of ``graph_without_edges``.

    Units are numbered before they are paired, so no text is made of a pair. The class of an origin is stated with the features.
    """
    names = star.dim_location.withColumn("id_ubicacion", expand(triples.FEATURE, {"id_ubicacion": F.col("id_ubicacion").cast("string")}))
    units = graph.numbered(names, "id_ubicacion")
    pairs = territory.build_proximity(units, radius_km)
    linked = pairs.select(F.col("id_origen").alias("s"), F.lit(iri("agua:nearbyWithin1500m")).alias("p"), F.col("id_vecino").alias("o"))
    apart = territory.origin_distances(units, radius_km)
    apart = apart.select(F.col("id_origen").alias("s"), F.lit(iri("agua:distanceKm")).alias("p"), F.col("distancia_km").cast("string").alias("o"))
    return linked, graph.numbered(apart, "o", "number", iri("xsd:decimal"))


def packed_edges(star: Star, radius_km: float = RADIUS_KM) -> DataFrame:
    """What ``numbered_edges`` states, as stored sets of bits per unit: every link and every distance of an origin is one triple of the graph."""
    units = materialise_table(territory.with_place_numbers(star.dim_location, "numero"), "numbered-units")
    return materialise_table(territory.edge_bits(units, radius_km, "numero"), "edge-bits")


def radius_edges(star: Star, radius_km: float = RADIUS_KM) -> DataFrame:
    """Every pair within the radius, made as it is read: their number grows with the square of the units, so none is stored."""
    return territory.build_proximity(star.dim_location, radius_km)


def radius_distances(star: Star, radius_km: float = RADIUS_KM) -> DataFrame:
    """The distances of each origin's radius edges, made as they are read."""
    return territory.origin_distances(star.dim_location, radius_km)


def nearest_edges(star: Star, k: int = 6, radius_km: float = RADIUS_KM) -> DataFrame:
    return materialise_table(territory.knn_pairs(star.dim_location, k, radius_km), "knn")


def observations(star: Star) -> DataFrame:
    """The numbered observations. Facts are dealt by ranges of the numbering's order, so they are summed and sorted where they come to lie."""
    tasks = max(math.ceil(star.fact.count() / _FACTS_PER_TASK), 1)
    dealt = star.fact.repartitionByRange(tasks, "id_ubicacion", "id_tiempo")
    return triples.number_observations(marts.aggregate_observations(dealt, star.dim_level))


def reduced_graph(
    star: Star, numbered: Callable[[], DataFrame], edges: Callable[[], DataFrame],
    k: int = 6, radius_km: float = RADIUS_KM, created: str = "1970-01-01T00:00:00Z",
) -> MappedGraph:
    """The coarser graph with the schema, made as patterns ask for it.

    ``numbered`` observations and ``edges`` are built at the first pattern that needs them.
    """
    rows = [*triples.metadata_rows(k, radius_km, created), *schema_rows()]

    def make(asked: set[str] | None) -> DataFrame:
        seen = numbered() if _asks(asked, triples.DEMO_OBSERVATION_PREDICATES) else None
        near = edges() if _asks(asked, triples.DEMO_EDGE_PREDICATES) else None
        maps = triples.demo_maps(star.dim_time, star.dim_location, star.dim_level, seen, star.fact_climate, near)
        return triples.materialise(maps, rows, asked)

    def read_star(predicates: list[str]) -> DataFrame | None:
        asked = set(predicates)
        if _asks(asked, triples.DEMO_EDGE_PREDICATES):
            return None
        # Observations are subjects of their own: they count if they state all that is asked.
        seen = numbered() if asked <= set(map(iri, triples.DEMO_OBSERVATION_PREDICATES)) else None
        maps = triples.demo_maps(star.dim_time, star.dim_location, star.dim_level, seen, star.fact_climate, None)
        return triples.mapped_star(maps, rows, predicates)

    return MappedGraph(star.fact.sparkSession, make, read_star)


def faulty_graph(graph: MappedGraph) -> MappedGraph:
    """The reduced graph with faults of every kind planted by rule."""
    return MappedGraph(graph.spark, lambda asked: with_faults(graph, asked))


def with_faults(graph: MappedGraph, asked: set[str] | None) -> DataFrame:
    """The triples of a graph under some predicates, some of them dropped, and others planted."""
    g = graph.make(asked)
    number = F.coalesce(F.substring_index("o", "/", -1).try_cast("long"), F.lit(-1))  # levels and classes have none
    dropped = (
        ((F.col("p") == iri("agua:location")) & (number % 97 == 0))
        | ((F.col("s") == iri("agua:meanHumidity")) & (F.col("p") == RDF_TYPE))
        | ((F.col("s") == iri("agua:developmentIndex")) & (F.col("p") == RDF_TYPE))
        | ((F.col("s") == iri("agua:consumoCDMX")) & (F.col("p") == iri("agua:unit")))
    )
    out = g.filter(~dropped)
    if asked is None or iri("qb:dataSet") in asked:
        periods = patterns.match(graph.make({iri("agua:period")}), p="agua:period")
        twice = periods.filter((number % 500 == 0) & F.col("s").contains("/aggobs/"))
        out = out.unionByName(
            twice.select(
                "s",
                F.lit(iri("qb:dataSet")).alias("p"),
                F.lit(iri("agua:climaCDMX")).alias("o"),
                F.lit("iri").alias("o_kind"),
                F.lit(None).cast("string").alias("datatype"),
                F.lit(None).cast("string").alias("lang"),
            )
        )
    rows = [
        ref("agua:consumoCDMX", "qb:structure", "agua:climaDSD"),
        ref("agua:vacioDSD", "rdf:type", "qb:DataStructureDefinition"),
    ]
    planted = [r for r in rows if asked is None or r[1] in asked]
    return out.unionByName(graph.spark.createDataFrame(planted, TRIPLE_SCHEMA)) if planted else out
