"""Ranking metrics and summaries for any number of keys and rows.

Scores collapse to distinct values with counts of positives and negatives before
anything is ordered, and cumulative counts come from :func:`running_totals`, so
neither a tied score nor a large key ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.operators.anomaly import (
    atypicality, inject_anomalies, isolation_scores, lof, with_signed_score,
)
from cubegraph.operators.ordering import running_totals
from cubegraph.session import materialise_table

# Names of the compared methods.
DEPLOYED = "A_g (deployed ranking)"
FOREST = "Isolation Forest"
LOCAL = "LOF"
METRICS = ["precision", "recall", "f1", "roc_auc", "pr_auc"]


def _ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    value = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def cumulative_counts(
    scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """True and false positives down to each distinct score, with its rank and own counts.

    ``tp_all``, ``fp_all`` and ``rank_all`` are the key's positives, negatives and
    number of distinct scores.
    """
    positive = F.sum(F.col(label).cast("long"))
    distinct = scored.groupBy(*by, score).agg(
        positive.alias("pos"), (F.count("*") - positive).alias("neg")
    )
    return running_totals(
        distinct, by, [F.desc(score)], {"tp": "pos", "fp": "neg", "rank": F.lit(1).cast("long")}
    )


def equal_alerts(
    scored: DataFrame,
    by: Sequence[str],
    unit: str,
    n: int | None = None,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Rows with ``predicted``: exactly the first ``n`` by (score, unit) per key.

    By default ``n`` is the key's number of positives.
    """
    ranked = running_totals(
        scored,
        by,
        [F.desc(score), unit],
        {"_rank": F.lit(1).cast("long"), "_pos": F.col(label).cast("long")},
    )
    wanted = F.col("_pos_all") if n is None else F.lit(n)
    return ranked.select(*scored.columns, (F.col("_rank") <= wanted).alias("predicted"))


def precision_recall_f1(
    scored: DataFrame, by: Sequence[str], unit: str, score: str = "score", label: str = "label"
) -> DataFrame:
    """Precision, recall and F1 with as many alerts as there are positives."""
    flagged = equal_alerts(scored, by, unit, score=score, label=label)
    hit = F.col("predicted") & F.col(label).cast("boolean")
    counts = flagged.groupBy(*by).agg(
        F.count_if("predicted").alias("alerts"),
        F.count_if(hit).alias("tp"),
        F.sum(F.col(label).cast("long")).alias("positives"),
    )
    return counts.select(
        *by,
        "alerts",
        _ratio(F.col("tp"), F.col("alerts")).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("alerts") + F.col("positives")).alias("f1"),
    )


def pr_curve(
    scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """One point per distinct score, from the lowest up, then (precision 1, recall 0).

    The end point leaves with the row of the highest score, so one pass serves both.
    """
    counts = cumulative_counts(scored, by, score, label)
    point = F.struct(
        (F.col("rank_all") - F.col("rank")).alias("point"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp_all"), empty=1.0).alias("recall"),
        F.col(score).cast("double").alias("threshold"),
    )
    end = F.struct(
        F.col("rank_all").alias("point"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    points = F.array_compact(F.array(point, F.when(F.col("rank") == 1, end)))
    return counts.select(*by, F.explode(points).alias("e")).select(*by, "e.*")


def ranking_metrics(
    scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision, in one pass.

    Both are null where a class is empty.
    """
    counts = cumulative_counts(scored, by, score, label)
    beaten = (F.col("fp_all") - F.col("fp")) + F.col("neg") / F.lit(2.0)
    share = F.col("pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return counts.groupBy(*by).agg(
        _ratio(F.sum(F.col("pos") * beaten), F.sum("pos") * F.sum("neg"), None).alias("roc_auc"),
        _ratio(F.sum(share), F.sum("pos"), None).alias("pr_auc"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    return ranking_metrics(scored, by, score, label).drop("pr_auc")


def average_precision(
    scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    return ranking_metrics(scored, by, score, label).drop("roc_auc")


def evaluate(scored: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """All metrics per key."""
    return precision_recall_f1(scored, by, unit).join(ranking_metrics(scored, by), list(by))


def summarise(results: DataFrame, by: str = "method", metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Mean and sample deviation of each metric per method."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return results.groupBy(by).agg(*aggs)


def sweep_scores(
    panel: DataFrame,
    seeds: Sequence[int],
    methods: Sequence[str] = (DEPLOYED, FOREST, LOCAL),
    rate: float = 0.03,
    spike_share: float = 0.70,
    n_trees: int = 300,
    k: int = 20,
) -> DataFrame:
    """Scores of every unit per seed and method, with the injected label.

    Seeds and methods are key columns: one job serves them all. The standardised
    totals are stored once, as each method reads them. They are rounded at six places, and the scores of the
    forest and the outlier factor at nine, so that the order in which totals were summed shows nowhere.
    """
    shaken = inject_anomalies(panel, rate=rate, spike_share=spike_share, seeds=seeds)
    labelled = atypicality(
        shaken, "alcaldia", ["unit_id", "is_anomaly"], "consumo", by=["seed"]
    )
    base = materialise_table(
        with_signed_score(labelled).select(
            "seed", "unit_id", F.col("is_anomaly").cast("int").alias("label"), "score", F.round("z", 6).alias("z")
        ),
        "standardised",
    )
    parts = []
    if DEPLOYED in methods:
        parts.append(base.select("seed", F.lit(DEPLOYED).alias("method"), "unit_id", "score", "label"))
    if FOREST in methods:
        forest = isolation_scores(base, "z", "unit_id", ["seed"], n_trees=n_trees)
        parts.append(
            forest.join(base.select("seed", "unit_id", "label"), ["seed", "unit_id"]).select(
                "seed", F.lit(FOREST).alias("method"), "unit_id", F.round("score", 9).alias("score"), "label"
            )
        )
    if LOCAL in methods:
        parts.append(
            lof(base.drop("score"), "z", k, by=["seed"]).select(
                "seed", F.lit(LOCAL).alias("method"), "unit_id", F.round("lof", 9).alias("score"), "label"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sweep(panel: DataFrame, seeds: Sequence[int], **options) -> DataFrame:
    """Metrics per (seed, method) at equal alert counts."""
    scores = materialise_table(sweep_scores(panel, seeds, **options), "scores")
    return evaluate(scores, ["seed", "method"], "unit_id")


def latency_summary(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and p95 per key; p95 is element ``int(0.95·n) − 1`` of the sorted samples.

    The element is found by counting equal samples, not by sorting a key in one
    task. For one sample the index is −1, the last element.
    """
    counted = samples.groupBy(*by, value).agg(F.count("*").alias("c"))
    weighted = F.col(value) * F.col("c")
    reached = running_totals(counted, by, [value], {"upto": "c", "sum": weighted})
    n = F.col("upto_all")
    wanted = F.floor(F.lit(0.95) * n)
    return (
        reached.filter(F.col("upto") >= F.when(wanted == 0, n).otherwise(wanted))
        .groupBy(*by)
        .agg(
            F.max(n).alias("n"),
            F.max(F.col("sum_all") / n).alias("mean"),
            F.min(value).alias("p95"),
        )
    )
