"""Queries over a graph of triples, written as patterns and DataFrame verbs.

A graph is a DataFrame of triples or a stored graph of numbered terms; queries read either through the same
interface, join on terms as the graph holds them, and fetch texts for their results only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.text import last_segment
from cubegraph.operators.ordering import top
from cubegraph.operators.termstore import Graph, as_graph
from cubegraph.session import sized
from cubegraph.sources.vocabulary import RDF_TYPE, iri

Pattern = tuple[str, str, str]
Source = DataFrame | Graph


def _is_variable(term: str) -> bool:
    return term.startswith(("?", "#"))


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given subject, predicate and object; an IRI object is no literal."""
    out = triples
    if p is not None:
        out = out.filter(F.col("p") == iri(p))
    if s is not None:
        out = out.filter(F.col("s") == iri(s))
    if o is not None:
        out = out.filter((F.col("o") == iri(o)) & (F.col("o_kind") != "literal"))
    return out


def _bindings(graph: Graph, pattern: Pattern, nodes: set[str]) -> DataFrame:
    """One column per variable of the pattern; ``#name`` is the value of a numeric literal."""
    rows = graph.rows(**{c: (None if _is_variable(t) else t) for c, t in zip("spo", pattern)})
    if pattern[2] in nodes:  # also a subject elsewhere, so a literal cannot join
        rows = rows.filter("node")
    columns: dict[str, Column] = {}
    for column, term in zip("spo", pattern):
        if not _is_variable(term):
            continue
        name = term[1:]
        if name in columns:
            rows = rows.filter(columns[name] == F.col(column))
        else:
            columns[name] = F.col("number" if term[0] == "#" else column)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def _star(graph: Graph, patterns: Sequence[Pattern], nodes: set[str]) -> DataFrame | None:
    """The solutions of patterns about one subject read off the rows of its map; None where they have to be joined."""
    names = [patterns[0][0], *[o for _, _, o in patterns if _is_variable(o)]]
    if len(patterns) < 2 or len({n[1:] for n in names}) < len(names) or any(_is_variable(p) for _, p, _ in patterns):
        return None
    rows = graph.star([p for _, p, _ in patterns])
    if rows is None:
        return None
    columns = [F.col("s").alias(names[0][1:])]
    for i, (_, _, o) in enumerate(patterns):
        if not _is_variable(o):
            rows = rows.filter(F.col(f"t{i}.node") & (F.col(f"t{i}.o") == graph.node(o)))
            continue
        if o in nodes:
            rows = rows.filter(F.col(f"t{i}.node"))
        columns.append(F.col(f"t{i}.number" if o[0] == "#" else f"t{i}.o").alias(o[1:]))
    return rows.select(*columns)


def _parts(graph: Graph, patterns: Sequence[Pattern], nodes: set[str]) -> tuple[list[Pattern], dict[Pattern, DataFrame]]:
    """The patterns in order, those of a star that rows tell as one, and its solutions."""
    waiting, stars = list(patterns), {}
    for subject in dict.fromkeys(p[0] for p in patterns if p[0].startswith("?")):
        own = [p for p in patterns if p[0] == subject]
        found = _star(graph, own, nodes)
        if found is not None:
            whole = (subject, *[o for _, _, o in own if _is_variable(o)])
            waiting[waiting.index(own[0])] = whole
            waiting = [p for p in waiting if p not in own]
            stars[whole] = found
    return waiting, stars


def bgp(triples: Source, patterns: Sequence[Pattern]) -> DataFrame:
    """Solutions of a connected set of patterns, as a bag with one column per variable.

    Variables are ``?term`` or, for the value of a numeric literal, ``#number``. Each pattern
    is a filter on the predicate; patterns join on their shared
    variables. The next pattern is the first one that shares most variables with
    those joined so far, so patterns about one subject follow each other and
    keep one partitioning. Where the rows of one map tell all that is asked about a subject,
    they are read instead of joined.
    """
    graph = as_graph(triples)
    nodes = {p[0] for p in patterns if _is_variable(p[0])}
    waiting, stars = _parts(graph, patterns, nodes)

    def solutions(pattern) -> DataFrame:
        return stars[pattern] if pattern in stars else _bindings(graph, pattern, nodes)

    out = solutions(waiting.pop(0))
    while waiting:
        shared = [
            [t[1:] for t in dict.fromkeys(p) if _is_variable(t) and t[1:] in out.columns]
            for p in waiting
        ]
        best = max(range(len(waiting)), key=lambda i: len(shared[i]))
        if not shared[best]:
            raise ValueError(f"pattern {waiting[0]} shares no variable with the others")
        out = out.join(solutions(waiting.pop(best)), shared[best])
    return out


def path(triples: Source, steps: Sequence[str]) -> DataFrame:
    """Start and end (s, o) of a chain of predicates."""
    last = len(steps) - 1
    names = ["?s", *[f"?n{i}" for i in range(last)], "?o"]
    return bgp(triples, [(names[i], p, names[i + 1]) for i, p in enumerate(steps)]).select("s", "o")


def count_pattern(triples: Source, s=None, p=None, o=None) -> DataFrame:
    return as_graph(triples).rows(s, p, o).agg(F.count("*").alias("n"))


def triple_count(triples: DataFrame, bag: bool = False) -> DataFrame:
    """Size of a graph, which holds no triple twice; of a ``bag`` each triple counts once."""
    return (triples.distinct() if bag else triples).agg(F.count("*").alias("n"))


def class_counts(triples: Source, classes: Sequence[str] | None = None) -> DataFrame:
    """Instances per class, all classes or the listed ones."""
    graph = as_graph(triples)
    typed = graph.rows(p=RDF_TYPE)
    if classes is not None:
        typed = typed.filter(F.col("o").isin(*[graph.node(c) for c in classes]))
    counted = typed.groupBy(F.col("o").alias("clase")).agg(F.count("*").alias("n"))
    return graph.texts(counted, "clase").select("clase", "n").orderBy(F.desc("n"), "clase")


def _whole(x: Column) -> Column:
    """Rounded to a whole number, halves towards positive infinity."""
    return F.floor(x.cast("double") + 0.5)


def _unit_totals(triples: Source, *measures: tuple[str, str]) -> DataFrame:
    """Measures summed per unit before anything else is joined to them."""
    patterns = [("?obs", "agua:location", "?unit")]
    patterns += [("?obs", predicate, f"#{name}") for name, predicate in measures]
    return (
        bgp(triples, patterns)
        .groupBy("unit")
        .agg(*[F.sum(n).alias(n) for n, _ in measures], F.count("*").alias("n"))
    )


def _neighbour_totals(triples: Source, origin: str) -> DataFrame:
    """Total of each neighbour of one unit: (unit, total), per neighbour edge.

    The origin's neighbours, and then their observations, are stored before they
    meet the rest of the graph: a few of them are broadcast, and the graph's
    observations are scanned but not shuffled.
    """
    near = sized(bgp(triples, [(origin, "agua:nearbyWithin1500m", "?unit")]), "neighbours")
    placed = bgp(triples, [("?obs", "agua:location", "?unit")])
    observed = sized(placed.join(near, "unit"), "neighbour-observations")
    totals = (
        bgp(triples, [("?obs", "agua:totalConsumption", "#c")])
        .join(observed, "obs")
        .groupBy("unit")
        .agg(F.sum("c").alias("total"))
    )
    return sized(totals, "neighbour-totals")


def _labels(triples: Source, subject: str, name: str) -> DataFrame:
    """Subjects with their label as text."""
    return as_graph(triples).texts(bgp(triples, [(f"?{subject}", "rdfs:label", f"?{name}")]), name, form="text")


def _borough_names(triples: Source) -> DataFrame:
    """Labels of the boroughs units refer to.

    Units share few boroughs, so joining them on it would gather a third of all
    units in one place; the few boroughs are found first, named, and stored.
    """
    used = bgp(triples, [("?unit", "agua:borough", "?b")]).select("b").distinct()
    named = _labels(triples, "b", "alcaldia").join(sized(used, "boroughs"), "b")
    return sized(named, "borough-names")


def _unit_boroughs(triples: Source) -> DataFrame:
    """Units with the name of their borough."""
    return (
        bgp(triples, [("?unit", "agua:borough", "?b")])
        .join(_borough_names(triples), "b")
        .select("unit", "alcaldia")
    )


def neighbour_consumption(triples: Source, origin: str, n: int = 10) -> DataFrame:
    """The origin's neighbours by their own consumption, first ``n``."""
    rows = (
        _neighbour_totals(triples, origin)
        .join(_labels(triples, "unit", "nombre"), "unit")
        .groupBy(F.col("unit").alias("vecino"), "nombre")
        .agg(F.sum("total").alias("consumo"))
    )
    named = as_graph(triples).texts(rows, "vecino").select("vecino", "nombre", "consumo")
    return top(named, [F.desc("consumo"), "vecino"], n)


def neighbours_by_label(triples: Source, origin: str, with_borough: bool = False) -> DataFrame:
    """Neighbour totals merged by name, or by name and borough name."""
    rows = _neighbour_totals(triples, origin).join(_labels(triples, "unit", "vecina"), "unit")
    keys = ["vecina"]
    if with_borough:
        rows = rows.join(_unit_boroughs(triples), "unit")
        keys.append("alcaldia")
    return (
        rows.groupBy(*keys)
        .agg(_whole(F.sum("total")).alias("consumo"))
        .orderBy(F.desc("consumo"), *keys)
    )


def neighbours(triples: Source, unit: str) -> DataFrame:
    """One-hop traversal from a chosen unit, by name and borough."""
    return neighbours_by_label(triples, unit, with_borough=True)


def _period_water(triples: Source, dataset: str | None = None) -> DataFrame:
    patterns = [("?obs", "agua:period", "?p"), ("?obs", "agua:totalConsumption", "#c")]
    if dataset:
        patterns.insert(0, ("?obs", "qb:dataSet", dataset))
    else:
        patterns.insert(0, ("?obs", "agua:location", "?loc"))
    return (
        bgp(triples, patterns)
        .groupBy("p")
        .agg(F.sum("c").alias("water"), F.count("*").alias("n"))
    )


def _period_temperature(triples: Source, dataset: str | None = None) -> DataFrame:
    patterns = [("?w", "agua:period", "?p"), ("?w", "agua:meanTemperature", "#t")]
    if dataset:
        patterns.insert(0, ("?w", "qb:dataSet", dataset))
    return (
        bgp(triples, patterns)
        .groupBy("p")
        .agg(F.sum("t").alias("heat"), F.count("*").alias("m"))
    )


def graph_climate_join(triples: Source) -> DataFrame:
    """Water and temperature per bimester through the shared period.

    Every observation meets every weather record of its period, so the mean is
    weighted by observations. Both sides are summed per period first; the
    products below restore the multiplicities of the row-by-row join.
    """
    when = bgp(triples, [("?p", "agua:year", "#anio"), ("?p", "agua:bimester", "#bimestre")])
    pairs = F.sum(F.col("n") * F.col("m"))
    return (
        _period_water(triples)
        .join(_period_temperature(triples), "p")
        .join(when, "p")
        .groupBy(F.col("anio").cast("int").alias("anio"), F.col("bimestre").cast("int").alias("bimestre"))
        .agg(
            F.sum(F.col("water") * F.col("m")).alias("agua"),
            (F.sum(F.col("heat") * F.col("n")).cast("double") / pairs).alias("temp_media"),
        )
        .orderBy("anio", "bimestre")
    )


def graph_climate_by_bimester(
    triples: Source,
    water_dataset: str = "agua:consumoCDMXDemo",
    climate_dataset: str = "agua:climaCDMX",
) -> DataFrame:
    """Water and mean temperature per bimester, each over its own periods."""
    when = bgp(triples, [("?p", "agua:bimester", "#bimestre")])
    water = (
        _period_water(triples, water_dataset)
        .join(when, "p")
        .groupBy("bimestre")
        .agg(_whole(F.sum("water")).alias("agua"))
    )
    heat = (
        _period_temperature(triples, climate_dataset)
        .join(when, "p")
        .groupBy("bimestre")
        .agg(_whole(F.sum("heat").cast("double") / F.sum("m")).alias("temp_media"))
    )
    return (
        water.join(heat, "bimestre")
        .select(F.col("bimestre").cast("int").alias("bimestre"), "agua", "temp_media")
        .orderBy("bimestre")
    )


def by_level(triples: Source) -> DataFrame:
    """Observations and total per development level."""
    reduced = (
        bgp(triples, [("?obs", "agua:developmentIndex", "?i"), ("?obs", "agua:totalConsumption", "#c")])
        .groupBy("i")
        .agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    )
    names = as_graph(triples).texts(bgp(triples, [("?i", "skos:prefLabel", "?nivel")]), "nivel", form="text")
    return (
        reduced.join(names, "i")
        .groupBy("nivel")
        .agg(F.sum("n").alias("observaciones"), F.sum("c").alias("total"))
        .orderBy(F.desc("total"), "nivel")
    )


def non_domestic_share(triples: Source) -> DataFrame:
    """Whole-number percentage of non-domestic consumption per borough name."""
    units = _unit_totals(
        triples, ("nd", "agua:nonDomesticConsumption"), ("t", "agua:totalConsumption")
    )
    total = F.nullif(F.sum("t").cast("double"), F.lit(0.0))
    return (
        units.join(_unit_boroughs(triples), "unit")
        .groupBy("alcaldia")
        .agg(_whole(100 * F.sum("nd").cast("double") / total).alias("pct_no_domestico"))
        .orderBy(F.desc("pct_no_domestico"), "alcaldia")
    )


def degree(triples: Source, n: int = 15) -> DataFrame:
    """Names by number of neighbours; units of one name are merged."""
    edges = (
        as_graph(triples)
        .rows(p="agua:nearbyWithin1500m")
        .groupBy(F.col("s").alias("unit"))
        .agg(F.count("*").alias("n"))
    )
    merged = (
        edges.join(_labels(triples, "unit", "colonia"), "unit")
        .groupBy("colonia")
        .agg(F.sum("n").alias("vecinas"))
    )
    return top(merged, [F.desc("vecinas"), "colonia"], n)


def units(triples: Source) -> DataFrame:
    """Features with a name, a named borough and coordinates."""
    rows = bgp(
        triples,
        [
            ("?unit", RDF_TYPE, "geo:Feature"),
            ("?unit", "agua:latitude", "#lat"),
            ("?unit", "agua:longitude", "#lon"),
            ("?unit", "agua:borough", "?b"),
        ],
    )
    named = rows.join(_labels(triples, "unit", "nombre"), "unit").join(_borough_names(triples), "b")
    return as_graph(triples).texts(named, "unit").select(
        last_segment(F.col("unit")).alias("id"),
        "nombre",
        "alcaldia",
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
    )


def load_units(triples: Source) -> DataFrame:
    """Distinct (borough, neighbourhood) names of the units that have both."""
    return (
        _labels(triples, "unit", "colonia")
        .join(_unit_boroughs(triples), "unit")
        .select("alcaldia", "colonia")
        .distinct()
    )
