"""Proximity of units: the radius relation and the nearest neighbours.

Both are directed: a distance is measured with the longitude scale of its origin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.geo import (
    KM_PER_DEGREE, RADIUS_KM, micro, micro_distance_km, scale_at,
)
from cubegraph.functions.numbers import of_thousandths, thousandths, whole_thousandths
from cubegraph.operators.ordering import enumerate_rows, top_k_per_key
from cubegraph.session import materialise_table

_PAIRS_PER_TASK, _ROWS_PER_TASK, _MOST_TASKS = 16_000_000, 500_000, 8192
_MARGIN = 1 + 1e-9  # keeps rounding from putting a partner two cells away


def _located(points: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Units with a coordinate, in whole micro-degrees."""
    return points.filter(F.col("latitud").isNotNull() & F.col("longitud").isNotNull()).select(
        "id_ubicacion", micro(F.col("latitud")).alias("y"), micro(F.col("longitud")).alias("x"), *carried
    )


def _degrees(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def _around(column: str, reach: int) -> Column:
    return F.explode(F.array(*[F.col(column) + d for d in range(-reach, reach + 1)]))


def _band_width(band: Column, lat_size: float | Column) -> Column:
    """Width in degrees of longitude of the cells of a latitude band: the reach at its edge nearer a pole."""
    size = F.lit(lat_size)
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * size
    narrowest = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.least(size / F.greatest(narrowest, F.lit(1e-9)), F.lit(400.0))


def proximity_pairs(
    points: DataFrame, radius_km: float = RADIUS_KM, chunk: int = 2048, carried: Sequence[str] = ()
) -> DataFrame:
    """All ordered pairs of different units at most ``radius_km`` apart.

    A grid turns the range condition into an equi-join on the cell: latitude bands as high as the
    radius, cut into cells as wide as the radius at the band's own latitude. An origin looks into the
    three bands and three cells around it, by the cells of its own band. Of a crowded cell the origins are dealt into
    parts of about ``chunk`` and the neighbours into parts 64 times as large, and each pair of parts is joined
    on its own. So nearly always one task has all pairs of an origin, and what is grouped by origin shrinks before it is exchanged.
    Each pair holds the neighbour's ``carried`` columns too.
    """
    located = _located(points, carried)
    lat_size = radius_km / KM_PER_DEGREE * _MARGIN
    band = F.floor(_degrees(F.col("y")) / F.lit(lat_size))
    column = F.floor(_degrees(F.col("x")) / _band_width(F.col("cy"), lat_size))
    cells = located.drop(*carried).withColumn("cy", band)
    around = (
        located.withColumn("cy", band)
        .select("id_ubicacion", "y", "x", *carried, _around("cy", 1).alias("cy"))
        .withColumn("cx", column)
        .select("id_ubicacion", "y", "x", *carried, "cy", _around("cx", 1).alias("cx"))
    )
    cells = cells.withColumn("cx", column)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cy", "cx").agg(F.count("*").alias(name))

    def parts(name: str, size: int) -> Column:
        return F.ceil(F.col(name) / F.lit(size)).cast("long")

    sizes = materialise_table(
        counted(cells, "n_a").join(counted(around, "n_b"), ["cy", "cx"]).select(
            "cy", "cx", "n_a", "n_b", parts("n_a", chunk).alias("parts_a"), parts("n_b", 64 * chunk).alias("parts_b")
        ),
        "cell-parts",
    )
    # Few bytes make many pairs, so the pairs to be looked at decide on the number of tasks, not the bytes.
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    looked_at, dealt = sizes.agg(F.sum(a * b), F.sum(a * F.col("parts_b") + b * F.col("parts_a"))).first()
    wanted = max((looked_at or 0.0) / _PAIRS_PER_TASK, (dealt or 0.0) / _ROWS_PER_TASK)
    tasks = min(max(math.ceil(wanted), 1), _MOST_TASKS)

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    def own(name: str) -> Column:
        return F.pmod(F.xxhash64("id_ubicacion"), F.col(name))

    origins = cells.join(sizes, ["cy", "cx"]).select(
        F.col("id_ubicacion").alias("id_origen"),
        F.col("y").alias("y_a"),
        F.col("x").alias("x_a"),
        scale_at(_degrees(F.col("y"))).alias("scale_a"),
        "cy",
        "cx",
        own("parts_a").alias("part_a"),
        every("parts_b").alias("part_b"),
    )
    nearby = around.join(sizes, ["cy", "cx"]).select(
        F.col("id_ubicacion").alias("id_vecino"),
        F.col("y").alias("y_b"),
        F.col("x").alias("x_b"),
        *carried,
        "cy",
        "cx",
        every("parts_a").alias("part_a"),
        own("parts_b").alias("part_b"),
    )
    distance = micro_distance_km(*[F.col(c) for c in ("y_a", "x_a", "scale_a", "y_b", "x_b")])
    keys = ["cy", "cx", "part_a", "part_b"]
    return (
        origins.repartition(tasks, *keys)
        .join(nearby.repartition(tasks, *keys), keys)
        .filter(F.col("id_origen") != F.col("id_vecino"))
        .select("id_origen", "id_vecino", distance.alias("distancia_km"), *carried)
        .filter(F.col("distancia_km") <= radius_km)
    )


def build_proximity(points: DataFrame, radius_km: float = RADIUS_KM, carried: Sequence[str] = ()) -> DataFrame:
    """Form of the relation that is kept: the exact distance decides, three places are kept."""
    return proximity_pairs(points, radius_km, carried=carried).withColumn(
        "distancia_km", thousandths(F.col("distancia_km")).cast("decimal(9,3)")
    )


def origin_distances(points: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """The distances of :func:`build_proximity` that each origin has, (id_origen, distancia_km), each once.

    Where pairs are made, the metres of an origin are gathered as bits, 64 to a word, so few rows are exchanged.
    """
    metres = proximity_pairs(points, radius_km).select("id_origen", whole_thousandths(F.col("distancia_km")).alias("m"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("m") % 64).cast("int"))
    words = metres.groupBy("id_origen", F.shiftright("m", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(F.getbit("bits", F.col("place")) == 1)
    return found.select("id_origen", of_thousandths(F.col("word") * 64 + F.col("place")).cast("decimal(9,3)").alias("distancia_km"))


def _spread(number: Column) -> Column:
    """The 31 lowest bits of a number, each two places from the next."""
    out = number.bitwiseAND(F.lit((1 << 31) - 1))
    for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, step)).bitwiseAND(F.lit(mask))
    return out


def with_place_numbers(points: DataFrame, name: str) -> DataFrame:
    """The located units of ``points`` with dense numbers along a Z-curve through the plane: units near each other have numbers near each other."""
    shift = F.lit(1 << 30)
    curve = F.shiftleft(_spread(F.col("y") + shift), 1).bitwiseOR(_spread(F.col("x") + shift))
    places = _located(points).groupBy("id_ubicacion").agg(F.min(curve).alias("_curve"))
    numbers = enumerate_rows(places, ["_curve", "id_ubicacion"], name).select("id_ubicacion", name)
    return points.join(numbers, "id_ubicacion")


def edge_bits(points: DataFrame, radius_km: float = RADIUS_KM, number: str = "id_vecino") -> DataFrame:
    """Links and distances of all pairs within the radius as sets of whole numbers, (id_origen, enlace, word, bits).

    Of an origin, ``enlace`` rows hold its neighbours and the others its distances in metres; the numbers 64 * word + place whose
    bits are set are in the set. Pairs are made once for both and gathered where they are made. Neighbours count by their ids, or by
    another ``number`` of theirs that ``points`` have: the nearer the numbers of units that are near, the fewer the words.
    """
    metres = whole_thousandths(F.col("distancia_km")).cast("long")
    numbers = F.array(
        F.struct(F.lit(True).alias("enlace"), F.col(number).alias("number")),
        F.struct(F.lit(False).alias("enlace"), metres.alias("number")),
    )
    pairs = proximity_pairs(points, radius_km, carried=[] if number == "id_vecino" else [number])
    stated = pairs.select("id_origen", F.explode(numbers).alias("e"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("e.number").bitwiseAND(F.lit(63)).cast("int"))
    return stated.groupBy("id_origen", F.col("e.enlace").alias("enlace"), F.shiftright("e.number", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def union_of_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two such families of sets."""
    return a.unionByName(b).groupBy("id_origen", "enlace", "word").agg(F.bit_or("bits").alias("bits"))


def count_bits(sets: DataFrame) -> DataFrame:
    """One row: how many links and distances the sets hold."""
    return sets.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def neighbour_degrees(units: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(id_ubicacion, alcaldia, vecinos, alcaldias) of units with a neighbour: how many, and of how many boroughs.

    Each pair brings its neighbour's borough, so the pairs are counted where they are made.
    """
    names = units.select("id_ubicacion", "alcaldia")
    pairs = build_proximity(units.withColumnRenamed("alcaldia", "otra"), radius_km, carried=["otra"])
    counted = pairs.groupBy("id_origen", "otra").agg(F.count("*").alias("n"))
    degrees = counted.groupBy(F.col("id_origen").alias("id_ubicacion")).agg(
        F.sum("n").alias("vecinos"), F.count("otra").alias("alcaldias")
    )
    return degrees.join(names, "id_ubicacion").select("id_ubicacion", "alcaldia", "vecinos", "alcaldias")


def _at_level(df: DataFrame, lat_size: float) -> DataFrame:
    """``df`` (y, x, level) with its cell: a latitude band, halved ``level`` times, and a column of that band's own width."""
    size = F.lit(lat_size) / F.pow(F.lit(2.0), F.col("level"))
    return df.withColumn("cy", F.floor(_degrees(F.col("y")) / size)).withColumn(
        "cx", F.floor(_degrees(F.col("x")) / _band_width(F.col("cy"), size))
    )


def _grid_levels(points: DataFrame, lat_size: float, wanted: int, max_level: int) -> int:
    """How often a radius-sized cell must be halved to hold about ``wanted`` points."""
    cells = _at_level(points.withColumn("level", F.lit(0)), lat_size).groupBy("cy", "cx").agg(F.count("*").alias("n"))
    fullest = cells.agg(F.max("n").alias("n")).first().n
    if not fullest or fullest <= wanted:
        return 0
    return min(max_level, math.ceil(math.log(fullest / wanted, 4)) + 1)


def _reach(band: Column, size: Column) -> Column:
    """Diagonal in kilometres of the cells of a latitude band, widest at its edge nearer the equator."""
    nearer = F.least(F.abs(band), F.abs(band + 1)) * size
    widest = F.when((band < 0) & (band + 1 > 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(nearer, F.lit(90.0)))))
    width = _band_width(band, size) * widest
    return F.sqrt(size * size + width * width) * F.lit(KM_PER_DEGREE * _MARGIN)


def knn_pairs(
    points: DataFrame,
    k: int = 6,
    radius_km: float = RADIUS_KM,
    max_level: int = 12,
    chunk: int = 65536,
) -> DataFrame:
    """The ``k`` nearest units by (distance, id), kept if within ``radius_km``.

    Units at the same coordinate share one search: a coordinate offers only its
    ``k + 1`` smallest ids, since a larger id there can never be chosen, and the
    result is handed to all its units. Each coordinate searches on the finest
    grid whose own cell already holds ``k + 1`` candidates, which bounds the
    distance of the k-th neighbour by the cell's diagonal; sparse places search
    the full radius. Dense places therefore never list all pairs in the radius. At every level each latitude band has
    cells of its own width, so no unit's cells depend on where others lie.
    """
    located = _located(points)
    lat_size = radius_km / KM_PER_DEGREE * _MARGIN
    offered = materialise_table(
        top_k_per_key(located, ["y", "x"], ["id_ubicacion"], k + 1), "knn-candidates"
    )
    levels = _grid_levels(offered, lat_size, k + 1, max_level)
    leveled = _at_level(offered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))), lat_size)
    counts = leveled.groupBy("level", "cy", "cx").agg(F.count("*").alias("n"))

    # One row per coordinate, with the finest level whose own cell is full enough.
    full = counts.filter((F.col("n") > k) & (F.col("level") > 0)).select("level", "cy", "cx")
    finest = leveled.join(full, ["level", "cy", "cx"], "left_semi").groupBy("y", "x").agg(F.max("level").alias("level"))
    coordinates = offered.select("y", "x").distinct()
    searches = _at_level(
        coordinates.join(finest, ["y", "x"], "left").withColumn("level", F.coalesce("level", F.lit(0))), lat_size
    )

    size = F.lit(lat_size) / F.pow(F.lit(2.0), F.col("level"))
    limit = F.when(F.col("level") == 0, F.lit(float(radius_km))).otherwise(
        F.least(F.lit(float(radius_km)), _reach(F.col("cy"), size))
    )
    parts = counts.select(
        "level", "cy", "cx", F.ceil(F.col("n") / F.lit(chunk)).cast("long").alias("parts")
    )
    candidates = leveled.join(parts, ["level", "cy", "cx"]).select(
        "level",
        "cy",
        "cx",
        F.pmod(F.xxhash64("id_ubicacion"), F.col("parts")).alias("part"),
        F.col("id_ubicacion").alias("id_vecino"),
        F.col("y").alias("y_b"),
        F.col("x").alias("x_b"),
    )
    # All cells that the limit reaches: bands by latitude, and in each band columns of its own width.
    up = F.col("limit_km") / F.lit(KM_PER_DEGREE / _MARGIN)
    aside = up / F.greatest(F.col("scale_a"), F.lit(1e-9))
    lat, lon, width = _degrees(F.col("y_a")), _degrees(F.col("x_a")), _band_width(F.col("cy"), size)
    probes = (
        searches.select(
            F.col("y").alias("y_a"),
            F.col("x").alias("x_a"),
            scale_at(_degrees(F.col("y"))).alias("scale_a"),
            "level",
            limit.alias("limit_km"),
        )
        .withColumn("cy", F.explode(F.sequence(F.floor((lat - up) / size), F.floor((lat + up) / size))))
        .withColumn(
            "cx",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(lon - aside, F.lit(-181.0)) / width), F.floor(F.least(lon + aside, F.lit(181.0)) / width)
                )
            ),
        )
        .join(parts, ["level", "cy", "cx"])
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    )
    distance = micro_distance_km(*[F.col(c) for c in ("y_a", "x_a", "scale_a", "y_b", "x_b")])
    found = (
        probes.join(candidates, ["level", "cy", "cx", "part"])
        .select("y_a", "x_a", "id_vecino", "limit_km", distance.alias("distancia_km"))
        .filter(F.col("distancia_km") <= F.col("limit_km"))
    )
    nearest = top_k_per_key(found, ["y_a", "x_a"], ["distancia_km", "id_vecino"], k + 1)
    lists = nearest.groupBy("y_a", "x_a").agg(
        F.array_sort(F.collect_list(F.struct("distancia_km", "id_vecino"))).alias("near")
    )
    others = F.filter("near", lambda x: x["id_vecino"] != F.col("id_ubicacion"))
    return (
        located.withColumnsRenamed({"y": "y_a", "x": "x_a"})
        .join(lists, ["y_a", "x_a"])
        .select(F.col("id_ubicacion").alias("id_origen"), F.explode(F.slice(others, 1, k)).alias("e"))
        .select("id_origen", "e.id_vecino", "e.distancia_km")
        .filter(F.col("distancia_km") <= radius_km)
    )
