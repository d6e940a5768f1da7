"""Namespaces, prefixes and the cube's schema as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Namespaces of the graph.
AGUA = "https://w3id.org/cdmx/agua/"
PREFIXES = {
    "agua": AGUA,
    "qb": "http://purl.org/linked-data/cube#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "time": "http://www.w3.org/2006/time#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "dcterms": "http://purl.org/dc/terms/",
    "prov": "http://www.w3.org/ns/prov#",
}

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_kind", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)


def iri(name: str) -> str:
    """Full IRI of a prefixed name; full IRIs and blank nodes pass through."""
    prefix, colon, local = name.partition(":")
    if colon and prefix in PREFIXES:
        return PREFIXES[prefix] + local
    return name


RDF_TYPE = iri("rdf:type")
LABEL = iri("rdfs:label")

# The cube's declared structure.
DATASETS = {"agua:consumoCDMX": "agua:consumoDSD", "agua:climaCDMX": "agua:climaDSD"}
STRUCTURES = {
    "agua:consumoDSD": {
        "label": "Consumption data structure definition",
        "dimensions": ["agua:period", "agua:location", "agua:developmentIndex"],
        "measures": [
            "agua:totalConsumption",
            "agua:averageConsumption",
            "agua:domesticConsumption",
            "agua:nonDomesticConsumption",
            "agua:mixedConsumption",
        ],
        "attributes": ["agua:unit"],
    },
    "agua:climaDSD": {
        "label": "Climate data structure definition",
        "dimensions": ["agua:period"],
        "measures": [
            "agua:maxTemperature",
            "agua:minTemperature",
            "agua:meanTemperature",
            "agua:meanHumidity",
            "agua:totalRainfall",
        ],
        "attributes": [],
    },
}
DIMENSION_RANGES = {
    "agua:period": "time:TemporalEntity",
    "agua:location": "geo:Feature",
    "agua:developmentIndex": "skos:Concept",
    "agua:borough": "rdfs:Resource",
    "agua:year": "xsd:gYear",
    "agua:bimester": "xsd:integer",
    "agua:date": "xsd:date",
}
EXTRA_MEASURES = ["agua:latitude", "agua:longitude", "agua:distanceKm"]
LEVELS = ["POPULAR", "BAJO", "MEDIO", "ALTO"]  # ranks 1 to 4
SCHEME_LABEL = "Índice de desarrollo"
NEARBY_LABEL = "nearby within 1500 m"
NEARBY_COMMENT = (
    "Derived from proximity between centroids with a threshold of 1500 m; "
    "it is not a Simple Features topological relation."
)


def ref(s: str, p: str, o: str) -> tuple:
    kind = "bnode" if o.startswith("_:") else "iri"
    return (iri(s), iri(p), iri(o), kind, None, None)


def literal(s: str, p: str, o, datatype: str | None = None, lang: str | None = None) -> tuple:
    return (iri(s), iri(p), str(o), "literal", iri(datatype) if datatype else None, lang)


def _structure_rows(name: str, parts: dict) -> list[tuple]:
    rows = [ref(name, "rdf:type", "qb:DataStructureDefinition")]
    rows.append(literal(name, "rdfs:label", parts["label"], lang="en"))
    local = name.partition(":")[2]
    components = [
        (role, prop) for role in ("dimension", "measure", "attribute") for prop in parts[role + "s"]
    ]
    for number, (role, prop) in enumerate(components, start=1):
        node = f"_:{local}{number}"
        rows += [ref(name, "qb:component", node), ref(node, f"qb:{role}", prop)]
        if role == "dimension":
            rows.append(literal(node, "qb:order", number, datatype="xsd:integer"))
        if role == "attribute":
            rows.append(ref(node, "qb:componentAttachment", "qb:DataSet"))
    return rows


def schema_rows() -> list[tuple]:
    """The cube's datasets, structures, properties and ordinal scheme."""
    rows = []
    for dataset, structure in DATASETS.items():
        rows += [ref(dataset, "rdf:type", "qb:DataSet"), ref(dataset, "qb:structure", structure)]
    rows.append(ref("agua:consumoCDMX", "agua:unit", "agua:cubicMetre"))
    for name, parts in STRUCTURES.items():
        rows += _structure_rows(name, parts)
    measures = [m for parts in STRUCTURES.values() for m in parts["measures"]] + EXTRA_MEASURES
    for prop, target in DIMENSION_RANGES.items():
        rows += [ref(prop, "rdf:type", "qb:DimensionProperty"), ref(prop, "rdfs:range", target)]
    for prop in measures:
        rows += [ref(prop, "rdf:type", "qb:MeasureProperty"), ref(prop, "rdfs:range", "xsd:decimal")]
    rows += [
        ref("agua:unit", "rdf:type", "qb:AttributeProperty"),
        ref("agua:unit", "rdfs:range", "skos:Concept"),
        ref("agua:cubicMetre", "rdf:type", "skos:Concept"),
        literal("agua:cubicMetre", "skos:prefLabel", "cubic metre", lang="en"),
        ref("agua:nearbyWithin1500m", "rdf:type", "rdf:Property"),
        ref("agua:nearbyWithin1500m", "rdfs:domain", "geo:Feature"),
        ref("agua:nearbyWithin1500m", "rdfs:range", "geo:Feature"),
        literal("agua:nearbyWithin1500m", "rdfs:label", NEARBY_LABEL, lang="en"),
        literal("agua:nearbyWithin1500m", "rdfs:comment", NEARBY_COMMENT, lang="en"),
        ref("agua:indiceDesarrollo", "rdf:type", "skos:ConceptScheme"),
        literal("agua:indiceDesarrollo", "rdfs:label", SCHEME_LABEL, lang="es"),
        ref("agua:ordinalRank", "rdf:type", "rdf:Property"),
        ref("agua:ordinalRank", "rdfs:range", "xsd:integer"),
    ]
    for rank, level in enumerate(LEVELS, start=1):
        concept = f"agua:devindex/{level}"
        rows += [
            ref("agua:indiceDesarrollo", "skos:hasTopConcept", concept),
            ref(concept, "skos:topConceptOf", "agua:indiceDesarrollo"),
            literal(concept, "skos:prefLabel", level, lang="es"),
            literal(concept, "skos:notation", level),
            literal(concept, "agua:ordinalRank", rank, datatype="xsd:integer"),
        ]
    return rows


def schema_triples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema_rows(), TRIPLE_SCHEMA)
