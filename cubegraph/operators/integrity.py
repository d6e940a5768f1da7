"""Data-cube integrity checks as anti joins and group counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.operators.ordering import top_k_per_key
from cubegraph.operators.patterns import Source, bgp, path
from cubegraph.operators.relational import missing, values_df
from cubegraph.operators.termstore import as_graph
from cubegraph.session import sized
from cubegraph.sources.vocabulary import RDF_TYPE

# Check names, in report order.
IC1 = "IC-1 unique DataSet"
IC2 = "IC-2 unique DSD"
IC3 = "IC-3 DSD includes measure"
IC11 = "IC-11 all dimensions required"
DIMENSIONS_TYPED = "Component dimensions typed"
MEASURES_TYPED = "Component measures typed"
UNIT_DECLARED = "Consumption datasets declare cubic-metre unit"
CHECKS = [IC1, IC2, IC3, IC11, DIMENSIONS_TYPED, MEASURES_TYPED, UNIT_DECLARED]
CONSUMPTION_DATASETS = ["agua:consumoCDMX", "agua:consumoCDMXDemo"]


def _not_one(g: Source, cls: str, predicate: str) -> DataFrame:
    """Subjects of a class with links, but not exactly one."""
    return (
        bgp(g, [("?focus", RDF_TYPE, cls), ("?focus", predicate, "?v")])
        .groupBy("focus")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") != 1)
        .select("focus", F.col("n").cast("string").alias("detail"))
    )


def ic1(g: Source) -> DataFrame:
    return _not_one(g, "qb:Observation", "qb:dataSet")


def ic2(g: Source) -> DataFrame:
    return _not_one(g, "qb:DataSet", "qb:structure")


def ic3(g: Source) -> DataFrame:
    """Structures without a measure."""
    structures = as_graph(g).rows(p=RDF_TYPE, o="qb:DataStructureDefinition").select(F.col("s").alias("focus"))
    measured = path(g, ["qb:component", "qb:measure"]).select(F.col("s").alias("focus"))
    return missing(structures, measured, "focus").withColumn("detail", F.lit(None))


def ic11(g: Source) -> DataFrame:
    """Observations lacking a dimension their structure requires.

    The dimensions a dataset requires come from the small schema part and are
    stored, so observations are not shuffled by their dataset, of which there are
    few; one anti join on (observation, dimension) finds the gaps.
    """
    required = sized(
        bgp(
            g,
            [
                ("?ds", "qb:structure", "?dsd"),
                ("?dsd", "qb:component", "?c"),
                ("?c", "qb:dimension", "?detail"),
            ],
        ).select("ds", "detail"),
        "required-dimensions",
    )
    graph = as_graph(g)
    linked = bgp(g, [("?focus", RDF_TYPE, "qb:Observation"), ("?focus", "qb:dataSet", "?ds")])
    # The schema declares a handful of dimensions; asked for one by one, nothing else of the graph is read.
    names = [r["detail"] for r in graph.texts(required.select("detail").distinct(), "detail").collect()]
    wanted = linked.join(required, "ds").select("focus", "detail")
    present = [
        graph.rows(p=name).select(F.col("s").alias("focus"), graph.node(F.col("p")).alias("detail")) for name in names
    ]
    return missing(wanted, reduce(DataFrame.unionByName, present), ["focus", "detail"]) if present else wanted


def _untyped(g: Source, role: str, cls: str) -> DataFrame:
    """Structures using a property in a role without declaring its class."""
    used = bgp(
        g,
        [
            ("?focus", RDF_TYPE, "qb:DataStructureDefinition"),
            ("?focus", "qb:component", "?c"),
            ("?c", role, "?detail"),
        ],
    ).select("focus", "detail")
    declared = as_graph(g).rows(p=RDF_TYPE, o=cls).select(F.col("s").alias("detail"))
    return missing(used, declared, "detail").select("focus", "detail")


def unit_undeclared(g: Source) -> DataFrame:
    graph = as_graph(g)
    datasets = graph.rows(p=RDF_TYPE, o="qb:DataSet").filter(
        F.col("s").isin(*[graph.node(d) for d in CONSUMPTION_DATASETS])
    )
    declared = graph.rows(p="agua:unit", o="agua:cubicMetre").select(F.col("s").alias("focus"))
    return missing(datasets.select(F.col("s").alias("focus")), declared, "focus").withColumn("detail", F.lit(None))


def _found(g: Source) -> list[tuple[str, DataFrame, bool]]:
    """(check, its violations as the graph's terms, whether their detail is a term)."""
    return [
        (IC1, ic1(g), False),
        (IC2, ic2(g), False),
        (IC3, ic3(g), False),
        (IC11, ic11(g), True),
        (DIMENSIONS_TYPED, _untyped(g, "qb:dimension", "qb:DimensionProperty"), True),
        (MEASURES_TYPED, _untyped(g, "qb:measure", "qb:MeasureProperty"), True),
        (UNIT_DECLARED, unit_undeclared(g), False),
    ]


def violations(g: Source) -> DataFrame:
    """Every violation as (check, focus, detail)."""
    graph, parts = as_graph(g), []
    for name, df, by_term in _found(g):
        rows = graph.texts(df, "focus", *(["detail"] if by_term else []))
        parts.append(rows.select(F.lit(name).alias("check"), "focus", F.col("detail").cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def check_integrity(g: Source) -> DataFrame:
    """Violations per check, checks without any included."""
    checks = values_df(as_graph(g).spark, [(c,) for c in CHECKS], "check string")
    found = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check")) for name, df, _ in _found(g)])
    counted = found.groupBy("check").agg(F.count("*").alias("n"))
    return checks.join(counted, "check", "left").select(
        "check", F.coalesce("n", F.lit(0)).alias("violations")
    )


def sample_violations(g: Source, n: int = 5) -> DataFrame:
    """First ``n`` violations of each check."""
    order = ["focus", F.asc_nulls_first("detail")]
    return top_k_per_key(violations(g), "check", order, n)
