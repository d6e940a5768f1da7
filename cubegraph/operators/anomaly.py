"""Atypical units: the ranking, label injection and two baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubegraph.operators.ordering import enumerate_rows, hash_ranks, running_totals, top
from cubegraph.session import materialise_table, sized

EPS = 1e-9
ALERT = 3  # scores above it are counted as alerts
HIGH, LOW = "alto", "bajo"


def group_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Population mean and deviation per group."""
    return df.groupBy(*by).agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sigma"))


def with_group_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Every row with the statistics of its group.

    An aggregate joined back rather than a window: a window would gather the
    largest group in one task. Groups are usually few, so their statistics are
    stored and the rows are not shuffled to meet them.
    """
    return df.join(sized(group_stats(df, by, column), "group-stats"), list(by))


def atypicality(
    rows: DataFrame,
    group: str = "alcaldia",
    unit: str | Sequence[str] = "colonia",
    measure: str = "consumo_total",
    eps: float = EPS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Deviation of each unit's total from its group's mean, in deviations.

    ``by`` adds keys, such as a seed, that separate independent rankings.
    """
    units = [unit] if isinstance(unit, str) else list(unit)
    # Stored, as the statistics and the scores both read the totals.
    totals = materialise_table(
        rows.groupBy(*by, group, *units).agg(
            F.coalesce(F.sum(measure).cast("double"), F.lit(0.0)).alias("total")
        ),
        "unit-totals",
    )
    scored = with_group_stats(totals, [*by, group], "total")
    distance = F.abs(F.col("total") - F.col("mu")) / (F.col("sigma") + F.lit(eps))
    return scored.withColumn("score", distance)


def with_direction(scores: DataFrame) -> DataFrame:
    """Above (on equality too) or below the mean, and the multiple of the mean."""
    return scores.withColumns(
        {
            "sentido": F.when(F.col("total") >= F.col("mu"), HIGH).otherwise(LOW),
            "veces": F.when(F.col("mu") > 0, F.col("total") / F.col("mu")).otherwise(0.0),
        }
    )


def with_signed_score(scores: DataFrame, eps: float = EPS) -> DataFrame:
    return scores.withColumn("z", (F.col("total") - F.col("mu")) / (F.col("sigma") + F.lit(eps)))


def filter_scores(scores: DataFrame, alcaldia: str | None = None, direction: str = "ambos") -> DataFrame:
    out = scores
    if alcaldia:
        out = out.filter(F.col("alcaldia") == alcaldia)
    if direction != "ambos":
        out = out.filter(F.col("sentido") == direction)
    return out


def atypical_panel(
    scores: DataFrame, alcaldia: str | None = None, direction: str = "ambos", n: int = 15
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` highest scores of the filtered ranking, and its one-row summary."""
    shown = filter_scores(scores, alcaldia, direction)
    summary = shown.agg(
        F.count_if(F.col("score") > ALERT).alias("sobre"),
        F.count("*").alias("total"),
        F.least(F.lit(n), F.count("*")).alias("mostradas"),
    )
    return top(shown, [F.desc("score"), "alcaldia", "colonia"], n), summary


def _whole_digest(*parts: Column) -> Column:
    """Whole number below 2**32 from the digest of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the digest of its parts."""
    return _whole_digest(*parts).cast("double") / F.lit(float(2**32))


def choose_anomalies(
    units: DataFrame, unit: str, rate: float, spike_share: float, seeds: Sequence[int]
) -> DataFrame:
    """Per seed, ``round(rate·n)`` units with a factor, and the others with factor 1.

    Units are ranked by the digest of (seed, unit). The first share are spikes
    of U(3, 6), the rest drops to U(0.05, 0.25).
    """
    seed = F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")
    drawn = units.select(unit, seed).withColumn("_digest", F.md5(F.concat_ws(":", "seed", unit)))
    ranked = hash_ranks(drawn, ["seed"], "_digest", "_rank", tie=[unit])
    n = units.agg(F.count("*")).scalar()
    chosen = F.bround(F.lit(float(rate)) * n, 0)
    spikes = F.bround(F.lit(float(spike_share)) * chosen, 0)
    u = _uniform(F.col("seed"), F.col(unit), F.lit("factor"))
    return ranked.select(
        "seed",
        unit,
        (F.col("_rank") <= chosen).alias("is_anomaly"),
        F.when(F.col("_rank") <= spikes, F.lit(3.0) + F.lit(3.0) * u)
        .when(F.col("_rank") <= chosen, F.lit(0.05) + F.lit(0.20) * u)
        .otherwise(F.lit(1.0))
        .alias("factor"),
    )


def inject_anomalies(
    panel: DataFrame,
    unit: str = "unit_id",
    measure: str = "consumo",
    rate: float = 0.03,
    spike_share: float = 0.70,
    seeds: Sequence[int] = (42,),
) -> DataFrame:
    """The panel once per seed, chosen units scaled by one factor over all periods."""
    labels = choose_anomalies(panel.select(unit).distinct(), unit, rate, spike_share, seeds)
    return panel.join(labels, unit).withColumn(
        measure, F.col(measure).cast("double") * F.col("factor")
    )


# ---------------------------------------------------------------- LOF


def _factors(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Outlier factors of sorted distinct values with multiplicities.

    Rows next to a cut edge of the bucket are context only.
    """
    v, m = pdf["_v"].to_numpy(), pdf["_m"].to_numpy().astype(float)
    want = min(k, int(pdf["_n"].iloc[0]) - 1)
    if want < 1:
        return pdf.assign(lof=1.0)
    rows = np.arange(len(v))[:, None] + np.arange(-want, want + 1)[None, :]
    inside = (rows >= 0) & (rows < len(v))
    rows = np.clip(rows, 0, len(v) - 1)
    gap = np.where(inside, np.abs(v[rows] - v[:, None]), np.inf)
    count = np.where(inside, m[rows], 0.0)
    count[:, want] -= 1  # the point itself
    order = np.argsort(gap, axis=1, kind="stable")  # equal gaps: lower value first
    rows, gap, count = (np.take_along_axis(a, order, axis=1) for a in (rows, gap, count))
    before = np.cumsum(count, axis=1) - count
    take = np.clip(want - before, 0, count)
    used = take > 0
    k_distance = np.max(np.where(used, gap, 0.0), axis=1)
    reach = np.where(used, np.maximum(k_distance[rows], gap), 0.0)
    density = 1.0 / ((take * reach).sum(axis=1) / want + 1e-10)
    return pdf.assign(lof=(take * density[rows]).sum(axis=1) / want / density)


def lof(df: DataFrame, column: str, k: int = 20, by: Sequence[str] = (), bucket: int = 50_000) -> DataFrame:
    """Local outlier factor on one dimension, with exactly ``k`` neighbours.

    Equal distances prefer the lower value. Copies of a value share their
    factor, so the search runs over distinct values with counts: a value held
    by a third of all rows is one row. Distinct values are numbered in order
    and cut into buckets; 3k rows of context on either side are enough, as a
    factor looks at densities k places away, these at k-distances k places
    further, and these at values another k away.
    """
    by = list(by)
    reach = 3 * k
    if bucket < reach:
        raise ValueError("a bucket must hold the context of its neighbours")
    values = df.groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_m"))
    numbered = enumerate_rows(values, [*by, "_v"], "_pos", start=0)
    if by:
        sizes = numbered.groupBy(*by).agg(F.sum("_m").alias("_n"))
        counted = numbered.join(sized(sizes, "lof-keys"), by)
    else:
        counted = numbered.withColumn("_n", numbered.agg(F.sum("_m")).scalar())
    home = F.floor(F.col("_pos") / F.lit(bucket))
    spread = F.sequence(
        F.floor((F.col("_pos") - reach) / F.lit(bucket)),
        F.floor((F.col("_pos") + reach) / F.lit(bucket)),
    )
    placed = counted.withColumn("_home", home).withColumn("_bucket", F.explode(spread))
    schema = T.StructType([*placed.schema.fields, T.StructField("lof", T.DoubleType())])
    factors = (
        placed.groupBy(*by, "_bucket")
        .applyInPandas(lambda pdf: _factors(pdf.sort_values("_pos", ignore_index=True), k), schema)
        .filter(F.col("_home") == F.col("_bucket"))
        .select(*by, "_v", "lof")
    )
    return df.withColumn("_v", F.col(column).cast("double")).join(factors, [*by, "_v"]).drop("_v")


# ---------------------------------------------------------------- isolation forest

#: Path lengths are kept at so many places, so that sums of them do not depend on their order.
PATH = "decimal(18,9)"


def _average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` points."""
    many = 2.0 * (F.log(n - 1.0) + F.lit(float(np.euler_gamma))) - 2.0 * (n - 1.0) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(many)


def _draws(sizes: DataFrame, by: Sequence[str], n_trees: int, sample: int, seed: int) -> DataFrame:
    """(keys, _tree, _rank): the ranks each tree draws, one at a digest's place in each of ``sample`` even stretches.

    Ranks follow digests themselves, so a stretch is a random part of the points, and no rank is drawn twice.
    """
    trees = sizes.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    slots = trees.withColumn("_m", F.least(F.lit(sample), F.col("_n"))).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))
    )
    low, high = F.expr("_slot * _n div _m"), F.expr("(_slot + 1) * _n div _m")
    place = _whole_digest(F.lit(seed), *[F.col(b) for b in by], F.col("_tree"), F.lit("slot"), F.col("_slot"))
    return slots.select(*by, "_tree", "_m", (low + F.pmod(place, high - low) + 1).alias("_rank"))


def grown_leaves(drawn: DataFrame, by: Sequence[str], sample: int, seed: int) -> DataFrame:
    """(keys, _tree, _low, _path): the leaves of all trees, grown level by level from the rows (keys, _tree, _m, _x).

    A node is numbered as in a heap; on every level each node that is not pure is cut at a digest's place between its least
    and greatest value. All levels partition by the tree, so the rows are exchanged once. A leaf covers the values above
    ``_low``, the last cut it lies above.
    """
    node = W.partitionBy(*by, "_tree", "_node")
    rows = drawn.withColumn("_node", F.lit(1).cast("long")).withColumn("_low", F.lit(-math.inf))
    rows = rows.repartition(*by, "_tree")
    deepest = F.length(F.bin(F.greatest(F.col("_m"), F.lit(2)) - 1))
    for depth in range((max(sample, 2) - 1).bit_length()):
        u = _uniform(F.lit(seed), *[F.col(b) for b in by], F.col("_tree"), F.lit("cut"), F.col("_node"))
        least, most = F.min("_x").over(node), F.max("_x").over(node)
        measured = rows.withColumns({"_least": least, "_most": most})
        drawn_cut = F.col("_least") + u * (F.col("_most") - F.col("_least"))
        cut = F.when(drawn_cut >= F.col("_most"), F.col("_least")).otherwise(drawn_cut)
        # A node of one value stays as it is; so does one that an earlier level left.
        splits = (F.col("_least") < F.col("_most")) & (deepest > depth)
        above = F.col("_x") > F.col("_cut")
        rows = measured.withColumn("_cut", F.when(splits, cut)).select(
            *by, "_tree", "_m", "_x",
            F.when(F.col("_cut").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + above.cast("long")).alias("_node"),
            F.when(F.col("_cut").isNotNull() & above, F.col("_cut")).otherwise(F.col("_low")).alias("_low"),
        )
    leaves = rows.groupBy(*by, "_tree", "_node").agg(F.first("_low").alias("_low"), F.count("*").alias("_size"))
    depth = F.length(F.bin("_node")) - 1
    return leaves.select(*by, "_tree", "_low", (depth + F.round(_average_path(F.col("_size")), 9)).cast(PATH).alias("_path"))


def isolation_scores(
    df: DataFrame, column: str, unit: str, by: Sequence[str], n_trees: int = 300, sample: int = 256, seed: int = 0
) -> DataFrame:
    """Isolation-forest score of each unit on one dimension, per key ``by``.

    Trees draw ``sample`` units each by their ranks in a digest's order and grow as relations, all at once. On one
    dimension a tree is a step function, so a forest is one too; its steps and the points are
    put in one order, where a point's depth is the running total of the steps below it. Points without a value are left out.
    """
    by = list(by)
    digest = F.md5(F.concat_ws(":", F.lit(seed), *by, unit))
    points = df.select(*by, unit, F.col(column).cast("double").alias("_x"), digest.alias("_d")).filter(F.col("_x").isNotNull())
    # Stored, as the draws and the scores both read the ranks.
    ranked = materialise_table(hash_ranks(points, by, "_d", "_rank", tie=[unit]).drop("_d"), "forest-points")
    sizes = sized(ranked.groupBy(*by).agg(F.count("*").alias("_n")), "forest-keys")
    drawn = _draws(sizes, by, n_trees, sample, seed).join(ranked.select(*by, "_rank", "_x"), [*by, "_rank"]).drop("_rank")
    leaves = grown_leaves(drawn, by, sample, seed)
    before = F.lag("_path").over(W.partitionBy(*by, "_tree").orderBy("_low"))
    steps = (
        leaves.select(*by, "_low", (F.col("_path") - F.coalesce(before, F.lit(0).cast(PATH))).alias("_step"))
        .groupBy(*by, F.col("_low").alias("_x"))
        .agg(F.sum("_step").alias("_step"))
    )
    # A step counts for the points above it: at one value points come first.
    events = ranked.select(*by, unit, "_x", F.lit(0).alias("_kind"), F.lit(0).cast("decimal(28,9)").alias("_step")).unionByName(
        steps.select(*by, F.lit(None).cast(ranked.schema[unit].dataType).alias(unit), "_x", F.lit(1).alias("_kind"), "_step")
    )
    depths = running_totals(events, by, ["_x", "_kind", unit], {"_depth": "_step"}).filter("_kind = 0")
    expected = F.greatest(_average_path(F.least(F.lit(sample), F.col("_n")).cast("double")), F.lit(1e-12))
    mean = F.col("_depth").cast("double") / F.lit(float(n_trees))
    return depths.join(sizes, by).select(*by, unit, F.pow(F.lit(2.0), -mean / expected).alias("score"))
