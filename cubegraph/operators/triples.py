"""From tables to triples.

A graph is a DataFrame (s, p, o, o_kind, datatype, lang) that holds each triple
once. A map describes how the rows of one table become triples; each table is
scanned once, however many properties the map has, and again for each predicate under which its rows repeat triples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegralType, StringType

from cubegraph.functions import dates, geo
from cubegraph.functions.numbers import fixed2
from cubegraph.functions.text import expand, iri_segment
from cubegraph.operators.ordering import enumerate_rows
from cubegraph.sources.vocabulary import (
    AGUA, RDF_TYPE, TRIPLE_SCHEMA, iri, literal as literal_row, ref as ref_row,
)

COLUMNS = ["s", "p", "o", "o_kind", "datatype", "lang"]

# Subject templates.
OBSERVATION = AGUA + "obs/{id_fact}"
AGGREGATE = AGUA + "aggobs/{id_obs}"
CLIMATE = AGUA + "clima/{id_fact_clima}"
FEATURE = AGUA + "colonia/{id_ubicacion}"
NEIGHBOUR = AGUA + "colonia/{id_vecino}"
BOROUGH = AGUA + "alcaldia/{alcaldia}"
GEOMETRY = AGUA + "geom/{id_ubicacion}"
PERIOD = AGUA + "period/{id_tiempo}"
LEVEL = AGUA + "devindex/{indice_des}"


@dataclass(frozen=True)
class Property:
    """One predicate of a map: a template, a constant or a literal column.

    ``row_unique`` states that no two rows of the table give the same triple,
    even if they name the same subject.
    """

    predicate: str
    value: str | Column
    kind: str = "literal"
    datatype: str | None = None
    lang: str | None = None
    row_unique: bool = False

    def triple(self, columns: dict[str, Column], segments: dict[str, Column]) -> Column:
        if self.kind == "iri":
            value = expand(self.value, segments)
        elif self.kind == "constant":
            value = F.lit(iri(self.value))
        else:
            value = (columns[self.value] if isinstance(self.value, str) else self.value).cast("string")
        kind = "literal" if self.kind == "literal" else "iri"
        return F.struct(
            F.lit(iri(self.predicate)).alias("p"),
            value.alias("o"),
            F.lit(kind).alias("o_kind"),
            F.lit(iri(self.datatype) if self.datatype else None).cast("string").alias("datatype"),
            F.lit(self.lang).cast("string").alias("lang"),
        )


def template(predicate: str, value: str, row_unique: bool = False) -> Property:
    return Property(predicate, value, "iri", row_unique=row_unique)


def constant(predicate: str, value: str) -> Property:
    return Property(predicate, value, "constant")


def text(predicate: str, column: str, lang: str | None = None) -> Property:
    return Property(predicate, column, lang=lang)


def typed(predicate: str, value: str | Column, datatype: str) -> Property:
    return Property(predicate, value, datatype=datatype)


def decimal(predicate: str, column: str) -> Property:
    return typed(predicate, column, "xsd:decimal")


@dataclass(frozen=True)
class TriplesMap:
    """Rows of ``table`` as triples about the subject its template names.

    ``key_unique`` states that no two rows name the same subject.
    """

    table: DataFrame
    subject: str
    cls: str | None
    properties: Sequence[Property] = field(default_factory=tuple)
    key_unique: bool = True

    def all_properties(self) -> list[Property]:
        typing = [constant(RDF_TYPE, self.cls)] if self.cls else []
        return [*typing, *self.properties]

    def repeating(self) -> set[str]:
        """Predicates under which this map may state one triple twice."""
        if self.key_unique:
            return set()
        return {iri(p.predicate) for p in self.all_properties() if not p.row_unique}

    def reading(self, chosen: Sequence[Property]) -> list[str] | None:
        """The columns that the subject and some properties are made of; None if an expression among them does not tell."""
        if any(isinstance(p.value, Column) for p in chosen):
            return None
        templates = [self.subject, *[p.value for p in chosen if p.kind == "iri"]]
        slots = [c for t in templates for c in re.findall(r"\{(\w+)\}", t)]
        return list(dict.fromkeys([*slots, *[p.value for p in chosen if p.kind == "literal"]]))

    def tells_apart(self, predicate: str) -> bool:
        """True if rows that differ in what the triples under ``predicate`` read never give one and the same triple.

        That holds where subject and object are made of one column each, whose values have a text of their own.
        """
        chosen = [p for p in self.all_properties() if iri(p.predicate) == predicate]
        needed = self.reading(chosen)
        if len(chosen) != 1 or needed is None:
            return False
        slots = [re.findall(r"\{(\w+)\}", t) for t in (self.subject, chosen[0].value) if "{" in t]
        plain = (IntegralType, DecimalType, DateType, BooleanType)
        return all(len(s) == 1 for s in slots) and all(isinstance(self.table.schema[c].dataType, plain) for c in needed)

    def triples(self, predicates: set[str] | None = None, once: bool = False) -> DataFrame:
        """The map's triples, or those under some predicates, in one scan.

        With ``once``, rows that agree in all that is read become one before any text is made of them.
        """
        chosen = [
            p for p in self.all_properties() if predicates is None or iri(p.predicate) in predicates
        ]
        needed = self.reading(chosen) if once else None
        table = self.table if needed is None else self.table.select(*needed).distinct()
        columns, segments = _terms(table)
        if len(chosen) == 1 and (read := self.reading(chosen)) is not None:  # what is missing shows before any text is made
            given = table.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in read], F.lit(True)))
            one = chosen[0].triple(columns, segments)
            return given.select(expand(self.subject, segments).alias("s"), one.alias("t")).select("s", "t.*")
        return (
            table.select(
                expand(self.subject, segments).alias("s"),
                F.explode(F.array(*[p.triple(columns, segments) for p in chosen])).alias("t"),
            )
            .filter(F.col("s").isNotNull() & F.col("t.o").isNotNull())
            .select("s", "t.*")
        )


    def star(self, predicates: Sequence[str]) -> DataFrame:
        """The subjects with a triple under each of some predicates that one property each states: s and a column per predicate, numbered, of o, o_kind and datatype.

        If no two rows name one subject, that is what a join of the triples on their subject gives, without the join.
        """
        columns, segments = _terms(self.table)
        chosen = [next(p for p in self.all_properties() if iri(p.predicate) == asked) for asked in predicates]
        values = [p.triple(columns, segments).dropFields("p", "lang").alias(f"t{i}") for i, p in enumerate(chosen)]
        stated = [F.col("r.s").isNotNull(), *[F.col(f"r.t{i}.o").isNotNull() for i in range(len(chosen))]]
        # As a generator's row: what is missing shows in texts that are made, and they are made once.
        made = F.explode(F.array(F.struct(expand(self.subject, segments).alias("s"), *values))).alias("r")
        return self.table.select(made).filter(reduce(lambda x, y: x & y, stated)).select("r.*")


def _terms(table: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """A table's columns, and as parts of an IRI: numbers need no encoding; text does, and a null gives no triple."""
    segments = {
        f.name: F.when(F.col(f.name).isNotNull(), iri_segment(F.col(f.name)))
        if isinstance(f.dataType, StringType)
        else F.col(f.name).cast("string")
        for f in table.schema
    }
    return {c: F.col(c) for c in table.columns}, segments


def _stem(subject: str) -> str:
    return subject.split("{", 1)[0]


def mapped_star(maps: Sequence[TriplesMap], rows: Sequence[tuple], predicates: Sequence[str]) -> DataFrame | None:
    """Subjects with a triple under each predicate, in the form of ``TriplesMap.star``; None where the rows of single maps do not tell.

    Subjects under different stems differ, so a stem counts if its maps and literal ``rows`` state all the predicates; one
    map then has to state them all, once each, and for no subject twice.
    """
    asked = set(predicates)
    by_stem: dict[str, list[TriplesMap]] = {}
    for m in maps:
        by_stem.setdefault(_stem(m.subject), []).append(m)
    if len(asked) < len(predicates) or any(a != b and a.startswith(b) for a in by_stem for b in by_stem):
        return None
    apart: dict[str, set[str]] = {}
    for r in rows:
        if r[1] in asked:
            apart.setdefault(next((stem for stem in by_stem if r[0].startswith(stem)), r[0]), set()).add(r[1])
    if any(key not in by_stem and some == asked for key, some in apart.items()):
        return None
    parts = []
    for stem, group in by_stem.items():
        stating = [(m, Counter(iri(p.predicate) for p in m.all_properties() if iri(p.predicate) in asked)) for m in group]
        stating = [(m, n) for m, n in stating if n]
        if apart.get(stem, set()).union(*[n for _, n in stating]) != asked:
            continue
        if stem in apart or len(stating) > 1 or not stating[0][0].key_unique or max(stating[0][1].values()) > 1:
            return None
        parts.append(stating[0][0].star(predicates))
    return reduce(DataFrame.unionByName, parts) if parts else None


def materialise(maps: Sequence[TriplesMap], rows: Sequence[tuple] = (), predicates: set[str] | None = None) -> DataFrame:
    """Union of the maps' triples and of literal ``rows``, each triple once; or of those under some ``predicates``.

    Two triples can only be equal on one subject stem and predicate. A distinct
    runs over the pairs of those that several maps or literal rows state, or one
    map repeats; everything else, the observations above all, is not shuffled. What a map alone repeats
    is made distinct by the columns it is made of, predicate by predicate, where these tell its triples apart.
    """
    spark = maps[0].table.sparkSession
    by_stem: dict[str, list[TriplesMap]] = {}
    for m in maps:
        by_stem.setdefault(_stem(m.subject), []).append(m)
    parts, waiting = [], [r for r in dict.fromkeys(rows) if predicates is None or r[1] in predicates]
    for stem, group in by_stem.items():
        own = [{iri(p.predicate) for p in m.all_properties()} for m in group]
        own = [stated if predicates is None else stated & predicates for stated in own]
        met = {r[1] for r in waiting if r[0].startswith(stem)}
        stated = Counter(p for some in [*own, met] for p in some)
        several = {p for p, n in stated.items() if n > 1}
        repeated = several.union(*[m.repeating() for m in group])
        shared = []
        for m, some in zip(group, own):
            if some - repeated:
                parts.append(m.triples(some - repeated))
            once = {p for p in some & repeated - several if m.tells_apart(p)}
            parts += [m.triples({p}, once=True) for p in sorted(once)]
            if m.key_unique and some & repeated - once:
                shared.append(m.triples(some & repeated - once))
            elif not m.key_unique:  # each predicate alone, so that rows agree in more of what is read
                shared += [m.triples({p}, once=True) for p in sorted(some & repeated - once)]
        if shared:
            touching = [r for r in waiting if r[0].startswith(stem) and r[1] in repeated]
            waiting = [r for r in waiting if r not in touching]
            if touching:
                shared.append(spark.createDataFrame(touching, TRIPLE_SCHEMA))
            parts.append(reduce(DataFrame.unionByName, shared).distinct())
    if waiting or not parts:
        parts.append(spark.createDataFrame(waiting, TRIPLE_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def graph_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two graphs, each a set already: the second adds the triples the first lacks."""
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in COLUMNS])
    return a.unionByName(b.alias("l").join(a.alias("r"), same, "left_anti"))


def ref(table: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Bring the parent's template columns to the child through their join key."""
    return table.join(parent, on)


def observation_map(fact: DataFrame, dim_level: DataFrame) -> TriplesMap:
    """Consumption observations; periods and units need only the key they join on."""
    return TriplesMap(
        ref(fact, dim_level, "id_indice_des"),
        OBSERVATION,
        "qb:Observation",
        (
            constant("qb:dataSet", "agua:consumoCDMX"),
            template("agua:period", PERIOD),
            template("agua:location", FEATURE),
            template("agua:developmentIndex", LEVEL),
            decimal("agua:totalConsumption", "consumo_total"),
            decimal("agua:averageConsumption", "consumo_prom"),
            decimal("agua:domesticConsumption", "consumo_total_dom"),
            decimal("agua:nonDomesticConsumption", "consumo_total_no_dom"),
            decimal("agua:mixedConsumption", "consumo_total_mixto"),
        ),
    )


def climate_map(fact_climate: DataFrame) -> TriplesMap:
    table = fact_climate.withColumns(
        {
            c: F.col(c).cast("decimal(18,6)")
            for c in ("temp_maxima", "temp_minima", "temp_promedio", "humedad_promedio")
        }
    )
    return TriplesMap(
        table,
        CLIMATE,
        "qb:Observation",
        (
            constant("qb:dataSet", "agua:climaCDMX"),
            template("agua:period", PERIOD),
            decimal("agua:maxTemperature", "temp_maxima"),
            decimal("agua:minTemperature", "temp_minima"),
            decimal("agua:meanTemperature", "temp_promedio"),
            decimal("agua:meanHumidity", "humedad_promedio"),
            decimal("agua:totalRainfall", "lluvia_total"),
        ),
    )


def feature_map(dim_location: DataFrame) -> TriplesMap:
    return TriplesMap(
        dim_location,
        FEATURE,
        "geo:Feature",
        (
            text("rdfs:label", "colonia", "es"),
            template("agua:borough", BOROUGH),
            decimal("agua:latitude", "latitud"),
            decimal("agua:longitude", "longitud"),
            template("geo:hasGeometry", GEOMETRY),
        ),
    )


def geometry_map(geometries: DataFrame) -> TriplesMap:
    return TriplesMap(
        geometries, GEOMETRY, "geo:Geometry", (typed("geo:asWKT", "wkt", "geo:wktLiteral"),)
    )


def proximity_map(edges: DataFrame, distances: bool = True) -> TriplesMap:
    """Edges, and their distance as a property of the origin.

    Equal distances of one origin are one triple; the edge table keeps them apart. Without ``distances`` these are left to ``distance_map``.
    """
    return TriplesMap(
        edges.withColumnRenamed("id_origen", "id_ubicacion"),
        FEATURE,
        "geo:Feature",
        (
            template("agua:nearbyWithin1500m", NEIGHBOUR, row_unique=True),
            *([decimal("agua:distanceKm", "distancia_km")] if distances else []),
        ),
        key_unique=False,
    )


def distance_map(distances: DataFrame) -> TriplesMap:
    """The distances of origins, each of an origin once."""
    value = Property("agua:distanceKm", "distancia_km", datatype="xsd:decimal", row_unique=True)
    return TriplesMap(distances.withColumnRenamed("id_origen", "id_ubicacion"), FEATURE, None, (value,), key_unique=False)


def time_map(dim_time: DataFrame) -> TriplesMap:
    return TriplesMap(
        dim_time.withColumn("dia_iso", dates.iso_date(F.col("fecha"))),
        PERIOD,
        "time:TemporalEntity",
        (
            typed("agua:year", "anio", "xsd:gYear"),
            typed("agua:bimester", "bimestre", "xsd:integer"),
            typed("agua:date", "dia_iso", "xsd:date"),
        ),
    )


def level_map(dim_level: DataFrame) -> TriplesMap:
    return TriplesMap(
        dim_level,
        LEVEL,
        "skos:Concept",
        (
            text("skos:prefLabel", "indice_des", "es"),
            constant("skos:inScheme", "agua:indiceDesarrollo"),
        ),
    )


# Wording of the reduced dataset's metadata.
DEMO_LABEL = "Water consumption, Mexico City (browser subset)"
DEMO_DESCRIPTION = (
    "Browser-sized subset of the knowledge graph materialised from the data warehouse. "
    "Observations are aggregated to the neighbourhood-period grain and proximity is limited "
    "to the {k} nearest neighbours within {radius} km."
)


def metadata_rows(k: int, radius_km: float, created: str) -> list[tuple]:
    """Identity and provenance of the reduced dataset; ``created`` is an ISO stamp."""
    demo = "agua:consumoCDMXDemo"
    described = DEMO_DESCRIPTION.format(k=k, radius=radius_km)
    return [
        ref_row(demo, "rdf:type", "qb:DataSet"),
        literal_row(demo, "rdfs:label", DEMO_LABEL, lang="en"),
        literal_row(demo, "dcterms:description", described, lang="en"),
        literal_row(demo, "dcterms:created", created, datatype="xsd:dateTime"),
        ref_row(demo, "prov:wasDerivedFrom", "agua:consumoCDMX"),
        ref_row(demo, "qb:structure", "agua:consumoDSD"),
        ref_row(demo, "agua:unit", "agua:cubicMetre"),
    ]


def flag_no_geometry(dim_location: DataFrame) -> DataFrame:
    """``hasNoGeometry`` is "true" without a coordinate and null with one."""
    bare = F.col("latitud").isNull() | F.col("longitud").isNull()
    return dim_location.withColumn("sin_geometria", F.when(bare, F.lit("true")))


def borough_map(dim_location: DataFrame) -> TriplesMap:
    boroughs = dim_location.select("alcaldia").distinct()
    return TriplesMap(boroughs, BOROUGH, None, (text("rdfs:label", "alcaldia", "es"),))


def place_map(dim_location: DataFrame) -> TriplesMap:
    flagged = flag_no_geometry(dim_location)
    located = flagged.withColumns(
        {
            "geom_id": F.when(F.col("sin_geometria").isNull(), F.col("id_ubicacion")),
            "latitud": F.when(F.col("sin_geometria").isNull(), F.col("latitud")),
            "longitud": F.when(F.col("sin_geometria").isNull(), F.col("longitud")),
        }
    )
    return TriplesMap(
        located,
        FEATURE,
        "geo:Feature",
        (
            text("rdfs:label", "colonia", "es"),
            template("agua:borough", BOROUGH),
            decimal("agua:latitude", "latitud"),
            decimal("agua:longitude", "longitud"),
            template("geo:hasGeometry", GEOMETRY.replace("id_ubicacion", "geom_id")),
            typed("agua:hasNoGeometry", "sin_geometria", "xsd:boolean"),
        ),
    )


def _demo_edge_map(edges: DataFrame) -> TriplesMap:
    table = edges.withColumnRenamed("id_origen", "id_ubicacion")
    return TriplesMap(
        table,
        FEATURE,
        None,
        (template("agua:nearbyWithin1500m", NEIGHBOUR, row_unique=True),),
        key_unique=False,
    )


def _demo_observation_map(observations: DataFrame) -> TriplesMap:
    measures = (
        ("agua:totalConsumption", "consumo_total"),
        ("agua:averageConsumption", "consumo_prom"),
        ("agua:domesticConsumption", "consumo_total_dom"),
        ("agua:nonDomesticConsumption", "consumo_total_no_dom"),
        ("agua:mixedConsumption", "consumo_total_mixto"),
    )
    return TriplesMap(
        observations,
        AGGREGATE,
        "qb:Observation",
        (
            constant("qb:dataSet", "agua:consumoCDMXDemo"),
            template("agua:location", FEATURE),
            template("agua:period", PERIOD),
            template("agua:developmentIndex", LEVEL),
            *[typed(p, fixed2(F.col(c)), "xsd:decimal") for p, c in measures],
            typed("agua:sourceRecords", "registros", "xsd:integer"),
        ),
    )


def _demo_climate_map(fact_climate: DataFrame) -> TriplesMap:
    measures = (
        ("agua:maxTemperature", "temp_maxima"),
        ("agua:minTemperature", "temp_minima"),
        ("agua:meanTemperature", "temp_promedio"),
        ("agua:totalRainfall", "lluvia_total"),
    )
    return TriplesMap(
        fact_climate,
        CLIMATE,
        "qb:Observation",
        (
            constant("qb:dataSet", "agua:climaCDMX"),
            template("agua:period", PERIOD),
            *[typed(p, fixed2(F.col(c)), "xsd:decimal") for p, c in measures],
        ),
    )


def number_observations(observations: DataFrame) -> DataFrame:
    """Sequential ids in (unit, day, level) order."""
    return enumerate_rows(observations, ["id_ubicacion", "id_tiempo", "indice_des"], "id_obs")


#: What the maps of edges and of aggregate observations state.
EDGE_PREDICATES = {"rdf:type", "agua:nearbyWithin1500m", "agua:distanceKm"}
DEMO_EDGE_PREDICATES = {"agua:nearbyWithin1500m"}
DEMO_OBSERVATION_PREDICATES = {
    "rdf:type", "qb:dataSet", "agua:location", "agua:period", "agua:developmentIndex", "agua:totalConsumption",
    "agua:averageConsumption", "agua:domesticConsumption", "agua:nonDomesticConsumption", "agua:mixedConsumption",
    "agua:sourceRecords",
}


def demo_maps(
    dim_time: DataFrame,
    dim_location: DataFrame,
    dim_level: DataFrame,
    observations: DataFrame | None,
    fact_climate: DataFrame,
    edges: DataFrame | None,
) -> list[TriplesMap]:
    """The maps of the reduced graph; None leaves the map of observations or edges out, where nothing it states is asked for."""
    return [
        borough_map(dim_location),
        place_map(dim_location),
        geometry_map(
            dim_location.filter(F.col("latitud").isNotNull() & F.col("longitud").isNotNull()).withColumn(
                "wkt", geo.wkt_point(F.col("longitud"), F.col("latitud"))
            )
        ),
        *([] if edges is None else [_demo_edge_map(edges)]),
        time_map(dim_time),
        level_map(dim_level),
        *([] if observations is None else [_demo_observation_map(observations)]),
        _demo_climate_map(fact_climate),
    ]


def demo_graph(
    dim_time: DataFrame,
    dim_location: DataFrame,
    dim_level: DataFrame,
    observations: DataFrame,
    fact_climate: DataFrame,
    edges: DataFrame,
    k: int = 6,
    radius_km: float = geo.RADIUS_KM,
    created: str = "1970-01-01T00:00:00Z",
    rows: Sequence[tuple] = (),
) -> DataFrame:
    """The reduced graph: numbered aggregate observations and nearest-neighbour edges.

    ``rows`` are literal triples to merge in, such as the schema.
    """
    maps = demo_maps(dim_time, dim_location, dim_level, observations, fact_climate, edges)
    return materialise(maps, [*metadata_rows(k, radius_km, created), *rows])
