from __future__ import annotations

import math
import hashlib
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubegraph.operators import anomaly, evaluation


def test_score_uses_the_population_deviation(spark):
    rows = [("A", "x", 1.0), ("A", "x", 2.0), ("A", "y", 9.0), ("B", "z", 5.0)]
    df = spark.createDataFrame(rows, "alcaldia string, colonia string, consumo_total double")
    got = {r.colonia: r for r in anomaly.with_direction(anomaly.atypicality(df)).collect()}
    assert got["x"].score == pytest.approx(1.0) and (got["x"].mu, got["x"].sigma) == (6.0, 3.0)
    assert (got["x"].sentido, got["y"].sentido, got["y"].veces) == ("bajo", "alto", 1.5)
    assert got["z"].score == 0.0 and got["z"].sentido == "alto"


def test_flat_and_empty_groups(spark):
    rows = [("A", "x", 0.0), ("A", "y", 0.0), ("A", "z", None)]
    df = spark.createDataFrame(rows, "alcaldia string, colonia string, consumo_total double")
    for r in anomaly.with_signed_score(anomaly.with_direction(anomaly.atypicality(df))).collect():
        assert (r.score, r.veces, r.sentido, r.z) == (0.0, 0.0, "alto", 0.0)


def test_panel_filters_and_counts(spark):
    rows = [("A", f"u{i}", 10.0 if i else 1000.0) for i in range(20)] + [("B", "w", 1.0)]
    df = spark.createDataFrame(rows, "alcaldia string, colonia string, consumo_total double")
    scores = anomaly.with_direction(anomaly.atypicality(df))
    head, summary = anomaly.atypical_panel(scores, "A")
    assert head.count() == 15 and tuple(summary.first()) == (1, 20, 15)
    head, summary = anomaly.atypical_panel(scores, "A", "alto")
    assert [r.colonia for r in head.collect()] == ["u0"] and tuple(summary.first()) == (1, 1, 1)


def panel(spark, n=200):
    rows = [(i, 2019, b, "A" if i % 3 else "B", f"c{i}", 100.0 + i) for i in range(n) for b in (1, 2, 3)]
    return spark.createDataFrame(rows, "unit_id long, anio int, bimestre int, alcaldia string, colonia string, consumo double")


def test_injection_shares_factors_and_counts(spark):
    shaken = anomaly.inject_anomalies(panel(spark), rate=0.1, spike_share=0.7, seeds=[1, 2])
    units = shaken.groupBy("seed", "unit_id", "is_anomaly").agg(
        F.count_distinct("factor").alias("k"), F.first("factor").alias("f"), F.count("*").alias("rows")
    ).collect()
    assert {(u.k, u.rows) for u in units} == {(1, 3)}
    for seed in (1, 2):
        hit = [u.f for u in units if u.seed == seed and u.is_anomaly]
        assert len(hit) == 20 and sum(3 <= f <= 6 for f in hit) == 14 and sum(0.05 <= f <= 0.25 for f in hit) == 6
    chosen = [{u.unit_id for u in units if u.seed == s and u.is_anomaly} for s in (1, 2)]
    assert chosen[0] != chosen[1]
    again = anomaly.inject_anomalies(panel(spark), rate=0.1, spike_share=0.7, seeds=[1])
    assert {r.unit_id for r in again.filter("is_anomaly").collect()} == chosen[0]


def brute_lof(values, k):
    n = len(values)
    k = min(k, n - 1)
    near = []
    for i, v in enumerate(values):
        order = sorted((abs(w - v), w, j) for j, w in enumerate(values) if j != i)
        near.append([(d, j) for d, _, j in order[:k]])
    kd = [max(d for d, _ in ns) for ns in near]
    lrd = [1 / (sum(max(kd[j], d) for d, j in ns) / k + 1e-10) for ns in near]
    return [sum(lrd[j] for _, j in ns) / k / lrd[i] for i, ns in enumerate(near)]


@pytest.mark.parametrize("shape", ["spread", "copies", "few", "one"])
def test_lof_equals_comparing_all_pairs(spark, shape):
    rng = random.Random(3)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(400)] + [9.0, -7.0],
        "copies": [0.5] * 150 + [round(rng.gauss(0, 1), 1) for _ in range(250)],
        "few": [1.0, 2.0, 4.0, 8.0],
        "one": [1.0, 1.0],
    }[shape]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.lof for r in anomaly.lof(df, "v", k=5, bucket=40).collect()}
    assert len(got) == len(values)
    assert [got[i] for i in range(len(values))] == pytest.approx(brute_lof(values, 5), rel=1e-9)


def test_lof_separates_keys(spark):
    rng = random.Random(4)
    data = {s: [rng.gauss(0, s) for _ in range(100)] for s in (1, 2)}
    df = spark.createDataFrame([(s, i, v) for s, vs in data.items() for i, v in enumerate(vs)], "seed int, i int, v double")
    got = {(r.seed, r.i): r.lof for r in anomaly.lof(df, "v", k=7, by=["seed"], bucket=30).collect()}
    for s, vs in data.items():
        assert [got[s, i] for i in range(100)] == pytest.approx(brute_lof(vs, 7), rel=1e-9)


def test_isolation_ranks_outliers_first(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(600)] + [12.0, -11.0, 15.0]
    df = spark.createDataFrame([(42, i, v) for i, v in enumerate(values)], "seed int, i int, v double")
    scores = {r.i: r.score for r in anomaly.isolation_scores(df, "v", "i", ["seed"], n_trees=100).collect()}
    assert len(scores) == len(values)
    assert sorted(scores, key=scores.get)[-3:] and set(sorted(scores, key=scores.get)[-3:]) == {600, 601, 602}
    assert all(0 < s < 1 for s in scores.values())
    middle = statistics.mean(scores[i] for i in range(600) if abs(values[i]) < 0.5)
    assert 0.35 < middle < 0.5  # typical points score below one half
    again = {r.i: r.score for r in anomaly.isolation_scores(df.repartition(3), "v", "i", ["seed"], n_trees=100).collect()}
    assert again == pytest.approx(scores)


def test_a_tree_of_two_points_has_the_known_depth(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0)], "seed int, u string, v double")
    got = anomaly.isolation_scores(df, "v", "u", ["seed"], n_trees=7).collect()
    assert [r.score for r in got] == pytest.approx([0.5, 0.5])  # depth 1 of an expected 1


def brute_forest(values, n_trees, sample, seed, key):
    """The same draws and cuts, tree by tree over plain lists."""
    digest = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)
    order = sorted(values, key=lambda u: (hashlib.md5(f"{seed}:{key}:{u}".encode()).hexdigest(), u))
    n = len(order)
    m = min(sample, n)
    average = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    total = dict.fromkeys(values, 0.0)
    for t in range(n_trees):
        drawn = []
        for j in range(m):
            low, high = j * n // m, (j + 1) * n // m
            drawn.append(values[order[low + digest(seed, key, t, "slot", j) % (high - low)]])
        leaves, todo = [], [(drawn, 1, 0, -math.inf)]
        while todo:
            part, node, depth, low = todo.pop()
            if min(part) == max(part) or depth == max((max(m, 2) - 1).bit_length(), 0):
                leaves.append((low, depth + round(average(len(part)), 9)))
                continue
            cut = min(part) + digest(seed, key, t, "cut", node) / 2**32 * (max(part) - min(part))
            cut = min(part) if cut >= max(part) else cut
            todo.append(([x for x in part if x <= cut], 2 * node, depth + 1, low))
            todo.append(([x for x in part if x > cut], 2 * node + 1, depth + 1, cut))
        leaves.sort()
        for u, x in values.items():
            total[u] += [p for low, p in leaves if low < x][-1]
    return {u: 2 ** -(d / n_trees / max(average(m), 1e-12)) for u, d in total.items()}


@pytest.mark.parametrize("sample", [256, 16])
def test_forest_against_trees_of_lists(spark, sample):
    rng = random.Random(sample)
    values = {i: round(rng.choice([rng.gauss(0, 1), 0.5, -2.0]), 3) for i in range(90)}
    rows = [(7, i, v) for i, v in values.items()] + [(8, 0, 1.0), (9, 0, 3.0), (9, 1, 3.0), (7, 1000, None)]
    df = spark.createDataFrame(rows, "seed int, i int, v double")
    got = {(r.seed, r.i): r.score for r in anomaly.isolation_scores(df, "v", "i", ["seed"], 12, sample, 3).collect()}
    expect = {(k, u): s for k, v in ((7, values), (8, {0: 1.0}), (9, {0: 3.0, 1: 3.0})) for u, s in brute_forest(v, 12, sample, 3, k).items()}
    assert got == pytest.approx(expect, abs=1e-9)


def curve(points):
    """Reference curve by walking distinct scores downwards."""
    total = sum(l for _, l in points)
    out, tp, fp = [], 0, 0
    for score in sorted({s for s, _ in points}, reverse=True):
        tp += sum(l for s, l in points if s == score)
        fp += sum(1 - l for s, l in points if s == score)
        out.append((tp / (tp + fp), tp / total if total else 1.0, score))
    return out[::-1] + [(1.0, 0.0, None)]


def auc(points):
    pos = [s for s, l in points if l]
    neg = [s for s, l in points if not l]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def ap(points):
    c = curve(points)
    return sum((b - a) * p for (p, b, _), (_, a, _) in zip(c[:-1], c[1:])) if sum(l for _, l in points) else None


def scored(spark, groups):
    rows = [(k, i, float(s), l) for k, ps in groups.items() for i, (s, l) in enumerate(ps)]
    return spark.createDataFrame(rows, "k string, unit int, score double, label int")


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(6)
    return {
        "tied": [(rng.randint(0, 5), int(rng.random() < 0.3)) for _ in range(200)],
        "distinct": [(rng.random(), int(rng.random() < 0.3)) for _ in range(150)],
        "negative": [(rng.random(), 0) for _ in range(20)],
        "positive": [(rng.random(), 1) for _ in range(20)],
    }


def test_curves_equal_walking_the_scores(spark, groups):
    got = defaultdict(list)
    for r in evaluation.pr_curve(scored(spark, groups), ["k"]).collect():
        got[r.k].append((r.point, r.precision, r.recall, r.threshold))
    for k, points in groups.items():
        expected = curve(points)
        assert [p[0] for p in sorted(got[k])] == list(range(len(expected)))
        for (_, p, rc, t), (ep, er, et) in zip(sorted(got[k], key=lambda x: x[0]), expected):
            assert (p, rc) == pytest.approx((ep, er)) and t == et


def test_areas_equal_their_definitions(spark, groups):
    df = scored(spark, groups)
    roc = {r.k: r.roc_auc for r in evaluation.roc_auc(df, ["k"]).collect()}
    pr = {r.k: r.pr_auc for r in evaluation.average_precision(df, ["k"]).collect()}
    for k, points in groups.items():
        assert roc[k] == (None if auc(points) is None else pytest.approx(auc(points)))
        assert pr[k] == (None if ap(points) is None else pytest.approx(ap(points)))


def test_equal_alerts_make_precision_equal_recall(spark, groups):
    got = {r.k: r for r in evaluation.precision_recall_f1(scored(spark, groups), ["k"], "unit").collect()}
    for k, points in groups.items():
        n = sum(l for _, l in points)
        order = sorted(range(len(points)), key=lambda i: (-points[i][0], i))[:n]
        hits = sum(points[i][1] for i in order)
        assert got[k].alerts == n
        expected = hits / n if n else 0.0
        assert (got[k].precision, got[k].recall, got[k].f1) == pytest.approx((expected,) * 3)


def test_sweep_covers_all_methods_and_seeds(spark):
    results = evaluation.sweep(panel(spark), [1, 2], rate=0.1, n_trees=20)
    rows = results.collect()
    assert {(r.seed, r.method) for r in rows} == {(s, m) for s in (1, 2) for m in (evaluation.DEPLOYED, evaluation.FOREST, evaluation.LOCAL)}
    assert all(r.alerts == 20 and r.precision == r.recall for r in rows)
    assert min(r.roc_auc for r in rows if r.method == evaluation.DEPLOYED) > 0.9
    summary = {r.method: r for r in evaluation.summarise(results).collect()}
    mine = [r.f1 for r in rows if r.method == evaluation.FOREST]
    assert summary[evaluation.FOREST].f1_mean == pytest.approx(statistics.mean(mine))
    assert summary[evaluation.FOREST].f1_std == pytest.approx(statistics.stdev(mine))


@pytest.mark.parametrize("n", [200, 7, 20, 1])
def test_p95_is_the_element_below_the_rank(spark, n):
    rng = random.Random(n)
    samples = [float(rng.randint(0, 40)) for _ in range(n)]
    df = spark.createDataFrame([("q", s) for s in samples], "w string, ms double")
    row = evaluation.latency_summary(df, ["w"], "ms").first()
    assert row.p95 == sorted(samples)[int(0.95 * n) - 1]
    assert (row.n, row["mean"]) == (n, pytest.approx(statistics.mean(samples)))
