from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubegraph import session
from cubegraph.operators import territory, triples

SCHEMA = "id_ubicacion long, latitud decimal(9,6), longitud decimal(9,6)"


def points(spark, coordinates):
    rows = [
        (i, None if lat is None else Decimal(f"{lat:.6f}"), None if lon is None else Decimal(f"{lon:.6f}"))
        for i, (lat, lon) in enumerate(coordinates, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def km(a, b):
    dy = float(Decimal(f"{a[0]:.6f}") - Decimal(f"{b[0]:.6f}"))
    dx = float(Decimal(f"{a[1]:.6f}") - Decimal(f"{b[1]:.6f}")) * math.cos(math.radians(float(f"{a[0]:.6f}")))
    return 111.32 * math.sqrt(dy * dy + dx * dx)


def brute(coordinates, radius, k=None):
    out = set()
    for i, a in enumerate(coordinates, 1):
        near = sorted(
            (km(a, b), j) for j, b in enumerate(coordinates, 1) if j != i and None not in (*a, *b)
        ) if None not in a else []
        for d, j in near[:k] if k else near:
            if d <= radius:
                out.add((i, j))
    return out


def pairs(df):
    got = [(r.id_origen, r.id_vecino) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def cloud(n, spread, seed):
    rng = random.Random(seed)
    return [(19.3 + rng.uniform(0, spread), -99.2 + rng.uniform(0, spread)) for _ in range(n)]


SHAPES = {
    "even": cloud(300, 0.1, 1),
    "dense": cloud(300, 0.002, 2),
    "mixed": cloud(150, 0.2, 3) + cloud(200, 0.0005, 4),
    "copies": cloud(60, 0.05, 5) + [(19.35, -99.15)] * 120 + [(19.3501, -99.15)] * 20,
    "gaps": [(None, None), (19.3, -99.2), (19.3, None), (19.3001, -99.2)],
    "wide": [(lat / 10 + x, 0.001 * i) for i, lat in enumerate(range(0, 600, 40)) for x in (0.0, 0.004, 0.009)],
    "polar": cloud(120, 0.05, 6) + cloud(60, 0.002, 7) + [(89.9999, 10.0), (89.9999, -170.0), (-89.9995, 0.0), (89.99, 179.999), (0.0, 0.0), (0.0001, -0.0001)],
    "single": [(19.3, -99.2)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_grid_join_equals_comparing_all_pairs(spark, shape):
    coordinates = SHAPES[shape]
    got = pairs(territory.proximity_pairs(points(spark, coordinates), 1.5, chunk=16))
    assert got == brute(coordinates, 1.5)


@pytest.mark.parametrize("shape, k", [*((s, 6) for s in SHAPES), ("mixed", 1), ("copies", 1)])
def test_nearest_neighbours_equal_sorting_all_pairs(spark, shape, k):
    coordinates = SHAPES[shape]
    got = pairs(territory.knn_pairs(points(spark, coordinates), k, 1.5, chunk=16))
    assert got == brute(coordinates, 1.5, k)


def test_equal_distances_prefer_the_smaller_id(spark):
    around = [(0.001, 0), (-0.001, 0), (0.001, 0), (-0.001, 0), (0.001, 0), (-0.001, 0), (0.001, 0)]
    coordinates = [(19.3, -99.2)] + [(19.3 + dy, -99.2 + dx) for dy, dx in around]
    got = pairs(territory.knn_pairs(points(spark, coordinates), 6))
    assert sorted(j for i, j in got if i == 1) == [2, 3, 4, 5, 6, 7]


def test_edges_are_directed(spark):
    # Within the radius seen from the northern point, beyond it from the southern one.
    south, north = (10.0, 0.0), (60.0, 0.0)
    radius = 111.32 * math.hypot(50, 20 * math.cos(math.radians(60.0))) + 1
    far = (60.0, 20.0)
    df = points(spark, [south, north, far])
    got = pairs(territory.proximity_pairs(df, radius))
    assert (3, 1) in got and (1, 3) not in got


def test_threshold_applies_before_rounding(spark):
    step = 1.5004 / 111.32
    df = points(spark, [(19.3, -99.2), (19.3 + step, -99.2), (19.3 - 1.4996 / 111.32, -99.2)])
    edges = {(r.id_origen, r.id_vecino): float(r.distancia_km) for r in territory.build_proximity(df).collect()}
    assert edges == {(1, 3): 1.5, (3, 1): 1.5}


def test_edges_as_bits_hold_every_link_and_distance_once(spark):
    df = points(spark, [*SHAPES["mixed"], (None, None)])
    edges = territory.build_proximity(df)
    expect = edges.count() + edges.select("id_origen", "distancia_km").distinct().count()
    sets = territory.edge_bits(df)
    assert territory.count_bits(sets).first().n == expect
    both = territory.union_of_bits(sets, sets)
    assert territory.count_bits(both).first().n == expect and both.count() == sets.count()
    assert sets.count() < expect and territory.count_bits(sets.limit(0)).first().n == 0
    held = {
        (r.id_origen, 64 * r.word + i) for r in sets.filter("enlace").collect() for i in range(64) if r.bits >> i & 1
    }
    assert held == pairs(edges)


def test_no_plan_compares_all_pairs(spark):
    df = points(spark, SHAPES["even"])
    for out in (territory.proximity_pairs(df), territory.knn_pairs(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_edges_lie_within_the_radius_edges(spark):
    df = points(spark, SHAPES["mixed"])
    assert pairs(territory.knn_pairs(df)) <= pairs(territory.proximity_pairs(df))
    assert territory.knn_pairs(df).groupBy("id_origen").count().agg(F.max("count")).first()[0] <= 6


def test_one_polar_unit_leaves_the_other_cells_as_they_are(spark):
    rows = [(i, 19.0 + i * 0.004, -99.0 - (i % 7) * 0.004) for i in range(60)] + [(99, 89.999999, 10.0), (98, None, 1.0)]
    points = spark.createDataFrame(rows, "id_ubicacion int, latitud double, longitud double")
    located = [r for r in rows if r[1] is not None]
    expected = {
        (a[0], b[0])
        for a in located
        for b in located
        if a[0] != b[0]
        and 111.32 * math.hypot(a[1] - b[1], (a[2] - b[2]) * math.cos(math.radians(a[1]))) <= 1.5
    }
    for chunk in (4096, 2):  # both sides of a crowded cell are cut into parts
        got = territory.proximity_pairs(points, chunk=chunk).select("id_origen", "id_vecino").collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_cells_do_not_depend_on_other_units(spark):
    """A unit near a pole leaves the cells of all others as they are, at every level."""
    some = SHAPES["mixed"]
    cells = lambda c: {tuple(r) for r in territory._at_level(
        territory._located(points(spark, c)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(6)))), 0.0135
    ).filter(f"id_ubicacion <= {len(some)}").select("id_ubicacion", "level", "cy", "cx").collect()}
    assert cells(some) == cells(some + [(89.9999, 5.0), (-89.9999, 5.0)])


def test_degrees_and_distances_equal_those_of_stored_pairs(spark):
    units = points(spark, SHAPES["mixed"] + SHAPES["copies"]).withColumn(
        "alcaldia", F.when(F.col("id_ubicacion") % 7 == 0, None).otherwise(F.concat(F.lit("b"), (F.col("id_ubicacion") % 3).cast("string")))
    )
    borough = {r.id_ubicacion: r.alcaldia for r in units.collect()}
    near = [(r.id_origen, r.id_vecino, r.distancia_km) for r in territory.build_proximity(units).collect()]
    got = {tuple(r) for r in territory.neighbour_degrees(units).collect()}
    others = {}
    for a, b, _ in near:
        others.setdefault(a, []).append(borough[b])
    assert got == {(a, borough[a], len(o), len(set(o) - {None})) for a, o in others.items()}
    apart = [tuple(r) for r in territory.origin_distances(units).collect()]
    assert len(apart) == len(set(apart)) and set(apart) == {(a, d) for a, _, d in near}


def test_no_pair_is_stored_or_exchanged(spark):
    """What is counted by origin shrinks where pairs are made: no exchange lies between a join of pairs and its sums."""
    units = points(spark, SHAPES["copies"]).withColumn("alcaldia", F.lit("a"))
    stored = len(session.stored_paths(spark))
    territory.build_proximity(units).groupBy("id_origen").count().collect()
    assert len(session.stored_paths(spark)) == stored + 1  # the sizes of cells alone


def test_a_pattern_of_one_unit_pairs_this_unit_alone(spark):
    units = points(spark, SHAPES["dense"])
    near = triples.proximity_map(territory.build_proximity(units)).triples({triples.iri("agua:nearbyWithin1500m")})
    one = near.filter(F.col("s") == triples.AGUA + "colonia/7")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "colonia/7" in plan[plan.index("Join") :]  # the filter lies below the join of pairs
    assert one.count() == near.filter(F.col("s").endswith("colonia/7")).count() > 0


def test_bits_by_place_hold_the_same_sets_in_fewer_words(spark):
    r = random.Random(3)
    near = [(19.3 + r.random() / 10, -99.2 + r.random() / 10) for _ in range(1500)]
    df = points(spark, [*near, (None, None)])
    numbered = territory.with_place_numbers(df, "numero").cache()
    numbers = {row.id_ubicacion: row.numero for row in numbered.collect()}
    assert sorted(numbers) == sorted(numbers.values()) == list(range(1, 1501))
    sets, by_id = territory.edge_bits(numbered, number="numero"), territory.edge_bits(df)
    assert territory.count_bits(sets).first().n == territory.count_bits(by_id).first().n
    held = {(row.id_origen, 64 * row.word + i) for row in sets.filter("enlace").collect() for i in range(64) if row.bits >> i & 1}
    assert held == {(a, numbers[b]) for a, b in pairs(territory.build_proximity(df))}
    assert 2 * sets.filter("enlace").count() < by_id.filter("enlace").count()
