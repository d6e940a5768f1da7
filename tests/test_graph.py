from __future__ import annotations

import datetime as dt
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubegraph.operators import dims, integrity, ordering, patterns, quality, termstore, territory, triples
from cubegraph.operators.triples import TriplesMap, decimal, template, text, typed
from cubegraph.plans import graphs
from cubegraph.sources import readers, writers
from cubegraph.sources.vocabulary import AGUA, RDF_TYPE, TRIPLE_SCHEMA, iri, literal, ref, schema_rows, schema_triples


@pytest.fixture(scope="module")
def tables(spark):
    """Two days, four units of which two share a name and one has no place, two levels."""
    time = spark.createDataFrame(
        [(1, dt.date(2019, 1, 5), 2019, 1), (2, dt.date(2019, 3, 5), 2019, 2)], "id_tiempo long, fecha date, anio int, bimestre int"
    )
    place = lambda v: Decimal(v)
    units = spark.createDataFrame(
        [
            (1, "GUSTAVO A. MADERO", "CENTRO", place("19.400000"), place("-99.100000")),
            (2, "GUSTAVO A. MADERO", "ROMA", place("19.401000"), place("-99.100000")),
            (3, "TLALPAN", "ROMA", place("19.402000"), place("-99.100000")),
            (4, "TLALPAN", 'EL "ALTO"', None, None),
        ],
        "id_ubicacion long, alcaldia string, colonia string, latitud decimal(9,6), longitud decimal(9,6)",
    )
    levels = spark.createDataFrame([(1, "ALTO"), (2, "BAJO")], "id_indice_des long, indice_des string")
    d = lambda v: None if v is None else Decimal(v)
    fact = spark.createDataFrame(
        [
            (1, 1, 1, 1, d("10.50"), d("2.00"), d("4.00"), d("6.50"), None),
            (2, 1, 2, 1, d("20.00"), None, None, d("20.00"), None),
            (3, 2, 3, 2, d("30.00"), d("3.00"), d("30.00"), None, None),
            (4, 2, 2, 2, d("40.00"), d("4.00"), None, d("10.00"), None),
            (5, 2, 2, 2, d("1.00"), d("1.00"), None, None, None),
        ],
        "id_fact long, id_tiempo long, id_ubicacion long, id_indice_des long, consumo_total decimal(18,2), consumo_prom decimal(18,2), "
        "consumo_total_dom decimal(18,2), consumo_total_no_dom decimal(18,2), consumo_total_mixto decimal(18,2)",
    )
    weather = spark.createDataFrame(
        [(1, 1, 20.0, 10.0, 15.0, 50.0, d("0.10")), (2, 2, 30.0, 12.0, 20.0, 60.0, d("0.00"))],
        "id_fact_clima long, id_tiempo long, temp_maxima double, temp_minima double, temp_promedio double, humedad_promedio double, lluvia_total decimal(18,2)",
    )
    edges = spark.createDataFrame(
        [(1, 2, d("0.111")), (1, 3, d("0.111")), (2, 1, d("0.111")), (2, 3, d("0.222"))], "id_origen long, id_vecino long, distancia_km decimal(9,3)"
    )
    return dict(time=time, units=units, levels=levels, fact=fact, weather=weather, edges=edges)


@pytest.fixture(scope="module")
def full(tables):
    return triples.materialise(
        [
            triples.observation_map(tables["fact"], tables["levels"]),
            triples.climate_map(tables["weather"]),
            triples.feature_map(tables["units"]),
            triples.geometry_map(dims.geometry_view(tables["units"])),
            triples.proximity_map(tables["edges"]),
            triples.time_map(tables["time"]),
            triples.level_map(tables["levels"]),
        ],
        schema_rows(),
    ).coalesce(2).cache()


@pytest.fixture(scope="module")
def reduced(tables):
    from cubegraph.operators.marts import aggregate_observations

    numbered = triples.number_observations(aggregate_observations(tables["fact"], tables["levels"]))
    return triples.demo_graph(
        tables["time"], tables["units"], tables["levels"], numbered, tables["weather"], tables["edges"], rows=schema_rows()
    ).coalesce(2).cache()


def test_schema_has_its_published_size(spark):
    assert schema_triples(spark).distinct().count() == 117


def test_full_graph_is_a_set_of_the_expected_size(full):
    # Observations 10 each less null measures, climate 8, features 4 or 6, geometries 2,
    # edges, distinct origin distances, periods 4, levels 3; the schema shares two labels.
    observations = 5 * 10 - 1 - 3 - 2 - 5
    features = 3 * 6 + (1 * 6 - 2)
    expected = observations + 2 * 8 + features + 3 * 2 + 4 + 3 + 2 * 4 + 2 * 3 + 117 - 2
    assert full.count() == expected == full.distinct().count()


def test_reduced_graph_is_a_set_of_the_expected_size(reduced):
    # Metadata 7, boroughs, features 8 or 4, edges, periods 4, levels 3, observations 11, climate 7.
    expected = 7 + 2 + 3 * 8 + 4 + 4 + 2 * 4 + 2 * 3 + 4 * 11 + 2 * 7 + 117 - 2
    assert reduced.count() == expected == reduced.distinct().count()


def test_equal_distances_of_an_origin_collapse(full):
    assert patterns.match(full, p="agua:distanceKm").count() == 3
    assert patterns.match(full, p="agua:nearbyWithin1500m").count() == 4


def test_literals_and_iris(full):
    one = {(r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1]): (r.o, r.o_kind, r.datatype, r.lang) for r in patterns.match(full, s="agua:obs/1").collect()}
    assert one["totalConsumption"] == ("10.50", "literal", iri("xsd:decimal"), None)
    assert one["developmentIndex"] == (AGUA + "devindex/ALTO", "iri", None, None)
    assert "mixedConsumption" not in one
    borough = patterns.match(full, s="agua:colonia/1", p="agua:borough").first()
    assert borough.o == AGUA + "alcaldia/GUSTAVO%20A.%20MADERO"
    assert patterns.match(full, s="agua:colonia/1", p="rdfs:label").first().lang == "es"
    assert patterns.match(full, s="agua:geom/1", p="geo:asWKT").first().o == "POINT(-99.100000 19.400000)"


def test_missing_measures_become_zero_in_the_reduced_graph(reduced):
    values = [r.o for r in patterns.match(reduced, p="agua:mixedConsumption").collect()]
    assert values == ["0.00"] * 4
    assert sorted(r.o for r in patterns.match(reduced, p="agua:sourceRecords").collect()) == ["1", "1", "1", "2"]


def test_units_without_a_place_are_flagged(reduced):
    flags = patterns.match(reduced, p="agua:hasNoGeometry").collect()
    assert [(r.s, r.o, r.datatype) for r in flags] == [(AGUA + "colonia/4", "true", iri("xsd:boolean"))]
    assert patterns.match(reduced, s="agua:colonia/4", p="geo:hasGeometry").count() == 0


def test_union_has_set_semantics(spark, full):
    assert triples.graph_union(full, full).count() == full.count()
    assert triples.graph_union(full, schema_triples(spark)).count() == full.count()


def test_observations_are_not_shuffled(tables):
    graph = triples.materialise(
        [triples.observation_map(tables["fact"], tables["levels"]), triples.climate_map(tables["weather"])], schema_rows()
    )
    assert "hashpartitioning(s#" not in graph._jdf.queryExecution().executedPlan().toString()


def test_repeated_subjects_are_deduplicated(spark):
    table = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id long, v string")
    one = TriplesMap(table, "http://x/{id}", "qb:DataSet", (text("rdfs:label", "v"),), key_unique=False)
    assert triples.materialise([one]).count() == 3


def test_patterns_join_on_shared_variables(full):
    out = patterns.bgp(full, [("?o", "agua:location", "?u"), ("?u", "rdfs:label", "?name"), ("?o", "agua:totalConsumption", "?c")])
    assert sorted((r.name, r.c) for r in out.collect()) == [
        ("CENTRO", "10.50"), ("ROMA", "1.00"), ("ROMA", "20.00"), ("ROMA", "30.00"), ("ROMA", "40.00"),
    ]
    with pytest.raises(ValueError, match="shares no variable"):
        patterns.bgp(full, [("?a", "agua:year", "?b"), ("?c", "agua:date", "?d")])
    steps = patterns.path(full, ["qb:component", "qb:measure"])
    assert steps.count() == 10


def test_repeated_variable_is_an_equality(spark):
    g = spark.createDataFrame([ref("agua:a", "agua:p", "agua:a"), ref("agua:a", "agua:p", "agua:b")], TRIPLE_SCHEMA)
    assert [r.x for r in patterns.bgp(g, [("?x", "agua:p", "?x")]).collect()] == [AGUA + "a"]


def test_literals_do_not_join_as_subjects(spark):
    g = spark.createDataFrame(
        [literal("agua:a", "agua:p", AGUA + "b"), literal("agua:b", "agua:q", "x")], TRIPLE_SCHEMA
    )
    assert patterns.bgp(g, [("?s", "agua:p", "?t"), ("?t", "agua:q", "?v")]).count() == 0


def test_neighbours_by_unit_name_and_borough(full, reduced):
    by_unit = [(r.vecino.rsplit("/", 1)[1], r.nombre, float(r.consumo)) for r in patterns.neighbour_consumption(full, "agua:colonia/1").collect()]
    assert by_unit == [("2", "ROMA", 61.0), ("3", "ROMA", 30.0)]
    assert [(r.vecina, r.consumo) for r in patterns.neighbours_by_label(full, "agua:colonia/1").collect()] == [("ROMA", 91)]
    got = [(r.vecina, r.alcaldia, r.consumo) for r in patterns.neighbours(reduced, "agua:colonia/1").collect()]
    assert got == [("ROMA", "GUSTAVO A. MADERO", 61), ("ROMA", "TLALPAN", 30)]
    assert patterns.neighbours(full, "agua:colonia/1").count() == 0  # boroughs carry no label there


def test_climate_mean_is_weighted_by_observations(full, reduced):
    got = [(r.bimestre, float(r.agua), r.temp_media) for r in patterns.graph_climate_join(full).collect()]
    assert got == [(1, 30.5, 15.0), (2, 71.0, 20.0)]
    independent = [tuple(r) for r in patterns.graph_climate_by_bimester(reduced).collect()]
    assert independent == [(1, 31, 15), (2, 71, 20)]


def test_levels_shares_degrees_and_units(full, reduced):
    assert [(r.nivel, r.observaciones, float(r.total)) for r in patterns.by_level(full).collect()] == [("BAJO", 3, 71.0), ("ALTO", 2, 30.5)]
    assert [tuple(r) for r in patterns.non_domestic_share(reduced).collect()] == [("GUSTAVO A. MADERO", 51), ("TLALPAN", 0)]
    assert [tuple(r) for r in patterns.degree(reduced).collect()] == [("CENTRO", 2), ("ROMA", 2)]
    assert sorted(r.id for r in patterns.units(reduced).collect()) == ["1", "2", "3"]
    assert patterns.units(full).count() == 0
    units = quality.require_cardinality(patterns.load_units(reduced), 4, "units")
    assert ("TLALPAN", "ROMA") in {tuple(r) for r in units.collect()}


def test_counts(full):
    assert patterns.count_pattern(full, p=RDF_TYPE, o="geo:Feature").first().n == 4
    assert patterns.triple_count(full.unionByName(full), bag=True).first().n == full.count()
    listed = {r.clase: r.n for r in patterns.class_counts(full, ["qb:Observation", "geo:Geometry"]).collect()}
    assert listed == {iri("qb:Observation"): 7, iri("geo:Geometry"): 3}


def test_lines_round_trip(spark, reduced, tmp_path):
    path = str(tmp_path / "kg")
    writers.write_ntriples(reduced, path)
    back = readers.read_ntriples(spark, path)
    assert back.exceptAll(reduced).count() == 0 and reduced.exceptAll(back).count() == 0


def test_lines_as_others_write_them(spark, tmp_path):
    path = tmp_path / "in.nt"
    path.write_text(
        '# a comment\n\n<http://a> <http://p> "caf\\u00E9 \\"q\\"\\n"@es . # tail\n'
        '_:b1 <http://p> _:b2 .\n<http://a> <http://p> "1"^^<http://t> .\n', encoding="utf-8"
    )
    got = {(r.s, r.o, r.o_kind, r.datatype, r.lang) for r in readers.read_ntriples(spark, str(path)).collect()}
    assert got == {
        ("http://a", 'café "q"\n', "literal", None, "es"),
        ("_:b1", "_:b2", "bnode", None, None),
        ("http://a", "1", "literal", "http://t", None),
    }
    bad = tmp_path / "bad.nt"
    bad.write_text("<http://a> nonsense .\n")
    with pytest.raises(Exception, match="not a triple"):
        readers.read_ntriples(spark, str(bad)).collect()


@pytest.fixture(scope="module")
def stored(full, reduced):
    return termstore.store_terms(full), termstore.store_terms(reduced)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stored_graph_holds_the_triples(full, stored):
    back = stored[0].frame().select(*triples.COLUMNS)
    assert plain(back) == plain(full)
    counted = {r.p: (r.n, r.subjects, r.objects) for r in termstore.count_by_predicate(stored[0].triples).collect()}
    expect = full.groupBy("p").agg(F.count("*"), F.count_distinct("s"), F.count_distinct("o"))
    assert counted == {r[0]: tuple(r)[1:] for r in expect.collect()}


def test_stored_graph_answers_as_its_triples_do(full, reduced, stored):
    for text, graph in zip((full, reduced), stored):
        for ask in (
            lambda g: patterns.neighbour_consumption(g, "agua:colonia/1"), lambda g: patterns.neighbours(g, "agua:colonia/1"),
            patterns.graph_climate_join, patterns.graph_climate_by_bimester, patterns.by_level, patterns.non_domestic_share,
            patterns.degree, patterns.units, patterns.load_units, patterns.class_counts,
        ):
            assert plain(ask(graph)) == plain(ask(text))
    assert patterns.count_pattern(stored[0], p=RDF_TYPE, o="geo:Feature").first().n == 4


def test_terms_of_one_digest_are_told_apart(spark, full, monkeypatch):
    whole = termstore.digest
    monkeypatch.setattr(termstore, "digest", lambda *a, **k: F.pmod(whole(*a, **k), F.lit(400)))
    graph = termstore.store_terms(full)
    assert graph.moved is not None and graph.terms.select("id").distinct().count() == graph.terms.count()
    assert plain(graph.frame().select(*triples.COLUMNS)) == plain(full)
    assert plain(patterns.by_level(graph)) == plain(patterns.by_level(full))
    assert plain(patterns.neighbours_by_label(graph, "agua:colonia/1")) == plain(patterns.neighbours_by_label(full, "agua:colonia/1"))


def test_union_of_numbered_triples(spark, full, stored):
    graph = stored[0]
    schema = graph.encoded(schema_triples(spark))
    assert termstore.union(graph.triples, graph.triples).count() == termstore.union(graph.triples, schema).count() == full.count()


def test_stars_join_bucket_by_bucket(spark, full, monkeypatch):
    """Only the pattern's predicates are read, and what is joined on the observation is not exchanged."""
    monkeypatch.setattr(termstore, "BUCKET_TERMS", 20)
    graph = termstore.store_terms(full)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stars = patterns.bgp(graph, [("?obs", "agua:developmentIndex", "?i"), ("?obs", "agua:totalConsumption", "#c"), ("?obs", "agua:location", "?u")])
        plan = stars._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "PartitionFilters: [isnotnull(p" in plan and "Bucketed: true" in plan
        assert plain(patterns.by_level(graph)) == plain(patterns.by_level(full))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


FAULTS = {
    integrity.IC1: [ref("agua:obs/1", "qb:dataSet", "agua:climaCDMX")],
    integrity.IC2: [ref("agua:consumoCDMX", "qb:structure", "agua:climaDSD")],
    integrity.IC3: [ref("agua:emptyDSD", "rdf:type", "qb:DataStructureDefinition")],
    integrity.IC11: [ref("agua:obs/99", "rdf:type", "qb:Observation"), ref("agua:obs/99", "qb:dataSet", "agua:climaCDMX")],
    integrity.DIMENSIONS_TYPED: [ref("agua:climaDSD", "qb:component", "_:n"), ref("_:n", "qb:dimension", "agua:odd"),
                                 *[ref(f"agua:clima/{i}", "agua:odd", "agua:v") for i in (1, 2)]],
    integrity.MEASURES_TYPED: [ref("agua:climaDSD", "qb:component", "_:m"), ref("_:m", "qb:measure", "agua:odd")],
    integrity.UNIT_DECLARED: [ref("agua:consumoCDMXDemo", "rdf:type", "qb:DataSet")],
}


def test_clean_graphs_pass_every_check(full, reduced):
    for graph in (full, reduced):
        assert {(r.check, r.violations) for r in integrity.check_integrity(graph).collect()} == {(c, 0) for c in integrity.CHECKS}


@pytest.fixture(scope="module")
def reports(spark, full):
    """Check reports per planted fault, a few at a time."""

    def run(check):
        faulty = full.unionByName(spark.createDataFrame(FAULTS[check], TRIPLE_SCHEMA))
        return {r.check: r.violations for r in integrity.check_integrity(faulty).collect()}

    full.count()
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(FAULTS, pool.map(run, FAULTS)))


@pytest.mark.parametrize("check", FAULTS)
def test_each_fault_is_reported_once_by_its_check(reports, check):
    assert reports[check] == {c: int(c == check) for c in integrity.CHECKS}


def test_stored_graphs_are_checked_alike(spark, full):
    rows = [r for faults in FAULTS.values() for r in faults]
    faulty = full.unionByName(spark.createDataFrame(rows, TRIPLE_SCHEMA))
    graph = termstore.store_terms(faulty)
    assert plain(integrity.check_integrity(graph)) == plain(integrity.check_integrity(faulty))
    assert plain(integrity.sample_violations(graph)) == plain(integrity.sample_violations(faulty))


def test_samples_are_cut_per_check(spark, full):
    rows = [ref(f"agua:obs/{i}", "qb:dataSet", "agua:climaCDMX") for i in range(1, 6)]
    faulty = full.unionByName(spark.createDataFrame(rows, TRIPLE_SCHEMA))
    got = integrity.sample_violations(faulty, 3).collect()
    assert [(r.check, r.detail) for r in got] == [(integrity.IC1, "2")] * 3


def test_totals_agree_between_graph_and_star(spark, tables, full):
    from cubegraph.operators.marts import water_by_bimester

    star = water_by_bimester(tables["fact"], tables["time"])
    assert {r.coincide for r in quality.reconcile_totals(patterns.graph_climate_join(full), star).collect()} == {True}
    off = star.withColumn("total_agua", F.col("total_agua") + 1)
    assert {r.coincide for r in quality.reconcile_totals(patterns.graph_climate_join(full), off).collect()} == {False}


@pytest.fixture(scope="module")
def star(tables):
    from cubegraph.plans.warehouse import Star

    return Star(
        readings=None, climate=None, dim_time=tables["time"], dim_location=tables["units"], dim_level=tables["levels"],
        fact=tables["fact"], fact_climate=tables["weather"],
    )


def not_built():
    raise AssertionError("no pattern asked for this table")


def test_mapped_graph_holds_the_triples_under_each_predicate(star, tables, full):
    graph = graphs.mapped_graph(star, lambda: tables["edges"])
    whole = plain(full)
    for p in (RDF_TYPE, iri("rdfs:label"), iri("agua:distanceKm"), iri("agua:period")):
        assert plain(graph.make({p}).select(*triples.COLUMNS)) == [r for r in whole if r[1] == p], p
    assert graph.make({"http://x/none"}).count() == 0
    assert plain(graph.frame) == whole


def test_maps_left_out_state_nothing_else(star, tables):
    stated = lambda m: {iri(p.predicate) for p in m.all_properties()}
    edges = tables["edges"]
    assert stated(triples.proximity_map(edges)) == {iri(p) for p in triples.EDGE_PREDICATES}
    maps = triples.demo_maps(star.dim_time, star.dim_location, star.dim_level, star.fact, star.fact_climate, edges)
    bare = triples.demo_maps(star.dim_time, star.dim_location, star.dim_level, None, star.fact_climate, None)
    assert len(maps) == len(bare) + 2
    assert [stated(m) for m in maps if m.table is star.fact] == [{iri(p) for p in triples.DEMO_OBSERVATION_PREDICATES}]
    assert stated(triples._demo_edge_map(edges)) == {iri(p) for p in triples.DEMO_EDGE_PREDICATES}


def test_mapped_graph_builds_edges_and_observations_only_for_patterns_that_ask(star, full, reduced):
    graph = graphs.mapped_graph(star, not_built)
    for ask in (patterns.by_level, patterns.graph_climate_join):
        assert plain(ask(graph)) == plain(ask(full))
    with pytest.raises(AssertionError, match="asked"):
        patterns.count_pattern(graph, p="agua:nearbyWithin1500m")
    coarse = graphs.reduced_graph(star, not_built, not_built)
    assert plain(patterns.load_units(coarse)) == plain(patterns.load_units(reduced))


def test_mapped_graphs_answer_as_their_triples_do(star, tables, full, reduced):
    numbered = graphs.observations(star).cache()
    mapped = graphs.mapped_graph(star, lambda: tables["edges"])
    coarse = graphs.reduced_graph(star, lambda: numbered, lambda: tables["edges"])
    for p in ("rdfs:label", "agua:nearbyWithin1500m", "agua:totalConsumption"):
        assert plain(coarse.make({iri(p)}).select(*triples.COLUMNS)) == plain(patterns.match(reduced, p=p)), p
    for ask in (patterns.class_counts, lambda g: patterns.neighbour_consumption(g, "agua:colonia/1")):
        assert plain(ask(mapped)) == plain(ask(full))
    faulty = graphs.faulty_graph(coarse)
    whole = faulty.frame.coalesce(2).cache()
    for p in (RDF_TYPE, "qb:structure", "agua:unit", "agua:location"):
        assert plain(faulty.rows(p=p)) == plain(termstore.as_graph(whole).rows(p=p)), p
    assert patterns.match(whole, s="agua:vacioDSD").count() == 1
    assert patterns.match(whole, s="agua:consumoCDMX", p="agua:unit").count() == 0


def test_rows_of_edges_are_one_before_texts_are_made(tables):
    edges = triples.proximity_map(tables["edges"])
    assert edges.triples({RDF_TYPE}, once=True).count() == 2
    assert edges.triples({RDF_TYPE, iri("agua:distanceKm")}, once=True).count() == 6  # (origin, distance) rows, two triples each


def test_rows_that_repeat_triples_are_distinct_by_predicate(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "a"), (1, 3, "b"), (1, None, None)], "k long, v long, t string")
    twice = TriplesMap(rows, AGUA + "x/{k}", "geo:Feature", (decimal("agua:v", "v"), text("agua:t", "t"), template("agua:w", AGUA + "w/{t}")), key_unique=False)
    got = triples.materialise([twice]).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in got} == {RDF_TYPE: 1, iri("agua:v"): 2, iri("agua:t"): 2, iri("agua:w"): 2}
    assert twice.tells_apart(iri("agua:v")) and not twice.tells_apart(iri("agua:t"))


STARS = [
    [("?obs", "agua:period", "?p"), ("?obs", "agua:mixedConsumption", "#c"), ("?obs", "agua:location", "?u")],
    [("?w", "qb:dataSet", "agua:climaCDMX"), ("?w", "agua:period", "?p")],
    [("?u", "agua:borough", "?b"), ("?u", "rdfs:label", "?n"), ("?b", "rdfs:label", "?m")],
    [("?obs", "agua:totalConsumption", "?x"), ("?x", "agua:period", "?p"), ("?obs", "agua:period", "?q")],
]


def test_patterns_about_one_subject_answer_as_their_join(star, reduced):
    numbered = graphs.observations(star).cache()
    coarse = graphs.reduced_graph(star, lambda: numbered, not_built)
    for asked in STARS:
        got, expect = patterns.bgp(coarse, asked), patterns.bgp(reduced, asked)
        assert plain(got.select(*sorted(got.columns))) == plain(expect.select(*sorted(got.columns))), asked


def test_patterns_about_one_subject_are_read_off_its_rows(spark, star, tables, full, reduced):
    mapped = graphs.mapped_graph(star, not_built)
    assert mapped.star(["agua:location", "agua:totalConsumption"]).count() == 5
    plan = patterns.bgp(mapped, STARS[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1  # observations meet the names of their levels
    assert mapped.star([RDF_TYPE, "agua:latitude"]) is None  # edges state the class, too
    assert mapped.star(["skos:prefLabel", "skos:inScheme"]) is None  # so does the schema
    coarse = graphs.reduced_graph(star, not_built, not_built)  # units need neither observations nor edges
    assert plain(patterns.units(coarse)) == plain(patterns.units(reduced))


def test_union_is_put_together_of_two_parts(spark, full, stored):
    graph = stored[0].triples
    kept, added = termstore.union_parts(graph, graph)
    assert kept.count() == full.count() and added.count() == 0


def test_stored_sets_of_edges_united_with_themselves_stay(star):
    edges = graphs.packed_edges(star)
    both = territory.union_of_bits(edges, edges)
    assert territory.count_bits(both).first().n == territory.count_bits(edges).first().n == 11  # six links; two distances of each end, one of the middle


def test_observations_are_exchanged_once_and_numbered_in_order(spark, star, monkeypatch):
    plans, store = [], ordering.materialise_table

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(ordering, "materialise_table", seen)
    monkeypatch.setattr(graphs, "_FACTS_PER_TASK", 7, raising=False)
    # The keys of the levels do not follow their names; every third reading comes twice, the third unit has most.
    levels = store(spark.createDataFrame([(1, "MEDIO"), (2, "ALTO"), (3, "BAJO")], "id_indice_des long, indice_des string"), "levels")
    keys = [(t, u, i) for t in range(1, 5) for u in (1, 2, 3, 3, 9) for i in (1, 2, 3)]
    rows = [(n, *k, Decimal(n), None if n % 2 else Decimal(n), Decimal(0), Decimal(0), None) for n, k in enumerate(keys + keys[::3])]
    fact = store(spark.createDataFrame(rows, star.fact.schema).repartition(3), "facts")
    got = graphs.observations(replace(star, fact=fact, dim_level=levels)).collect()
    assert len(plans) == 1 and len(re.findall(r"(?<!Broadcast)Exchange ", plans[0])) == 1, plans
    name = {1: "MEDIO", 2: "ALTO", 3: "BAJO"}
    groups = {}
    for n, (t, u, i) in enumerate(keys + keys[::3]):
        groups.setdefault((u, t, name[i]), []).append(n)
    assert sorted(
        (r.id_obs, (r.id_ubicacion, r.id_tiempo, r.indice_des), r.consumo_total, r.consumo_prom, r.registros) for r in got
    ) == [
        (k, key, sum(ns), sum(even) / len(even) if (even := [n for n in ns if n % 2 == 0]) else None, len(ns))
        for k, (key, ns) in enumerate(sorted(groups.items()), 1)
    ]
