"""Atypical units, injected labels, baselines and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubegraph.operators import anomaly, evaluation, marts
from cubegraph.plans.registered.base import Query, registrar

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)

SEEDS = list(range(42, 62))  # twenty runs


def _scores(c):
    return anomaly.with_signed_score(
        anomaly.with_direction(anomaly.atypicality(c.mart, "alcaldia", "colonia"))
    )


def _panel(c):
    """Real totals per unit and bimester."""
    s = c.star
    return (
        s.fact.join(s.dim_time.select("id_tiempo", "anio", "bimestre"), "id_tiempo")
        .groupBy("id_ubicacion", "anio", "bimestre")
        .agg(F.sum("consumo_total").alias("consumo"))
        .join(s.dim_location.select("id_ubicacion", "alcaldia", "colonia"), "id_ubicacion")
        .withColumnRenamed("id_ubicacion", "unit_id")
    )


@query("""
SELECT alcaldia, ROUND(mu, 6) AS mu, ROUND(sigma, 6) AS sigma FROM (SELECT DISTINCT alcaldia, mu, sigma FROM totales)""")
def group_stats(c):
    totals = anomaly.atypicality(c.mart).select("alcaldia", "colonia", "total")
    stats = anomaly.group_stats(totals, ["alcaldia"], "total")
    return stats.select("alcaldia", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("""
SELECT alcaldia, colonia, total, ROUND(mu, 6) AS mu, ROUND(sigma, 6) AS sigma, ROUND(score, 6) AS score, ROUND(z, 6) AS z,
  CASE WHEN total >= mu THEN 'alto' ELSE 'bajo' END AS sentido, ROUND(CASE WHEN mu > 0 THEN total/mu ELSE 0 END, 6) AS veces FROM totales""")
def atypicality(c):
    return _scores(c).select(
        "alcaldia", "colonia", "total", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"),
        F.round("score", 6).alias("score"), F.round("z", 6).alias("z"), "sentido",
        F.round("veces", 6).alias("veces"),
    )


@query("""
SELECT alcaldia, colonia, total, ROUND(score, 6) AS score FROM totales WHERE total >= mu
ORDER BY totales.score DESC, alcaldia, colonia LIMIT 15""")
def atypical_panel(c):
    head, _ = anomaly.atypical_panel(_scores(c), direction="alto")
    return head.select("alcaldia", "colonia", "total", F.round("score", 6).alias("score"))


@query("""
SELECT COUNT(CASE WHEN score > 3 THEN 1 END) AS sobre, COUNT(*) AS total, LEAST(15, COUNT(*)) AS mostradas
FROM totales WHERE alcaldia = 'NATION_3' AND total < mu""")
def atypical_summary(c):
    _, summary = anomaly.atypical_panel(_scores(c), "NATION_3", "bajo")
    return summary


_INJECTED = """etiquetas AS MATERIALIZED (
  SELECT seed, unit_id, r <= chosen AS is_anomaly,
    CASE WHEN r <= spikes THEN CAST(3 AS DOUBLE) + CAST(3 AS DOUBLE) * u WHEN r <= chosen THEN CAST(0.05 AS DOUBLE) + CAST(0.2 AS DOUBLE) * u ELSE CAST(1 AS DOUBLE) END AS factor
  FROM (SELECT seed, unit_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || unit_id), unit_id) AS r,
      CAST(CAST('0x' || SUBSTR(md5(seed || ':' || unit_id || ':factor'), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u,
      round_even(CAST(0.03 AS DOUBLE) * n, 0) AS chosen, round_even(CAST(0.7 AS DOUBLE) * round_even(CAST(0.03 AS DOUBLE) * n, 0), 0) AS spikes
    FROM (SELECT DISTINCT unit_id FROM panel) CROSS JOIN (SELECT COUNT(DISTINCT unit_id) AS n FROM panel)
      CROSS JOIN (SELECT UNNEST(range(42, 62)) AS seed)))"""


@query(f"""WITH {_INJECTED}
SELECT seed, is_anomaly, CAST(COUNT(*) AS BIGINT) AS filas, CAST(COUNT(DISTINCT p.unit_id) AS BIGINT) AS unidades,
  ROUND(SUM(CAST(p.consumo AS DOUBLE) * e.factor), 2) AS consumo
FROM panel p JOIN etiquetas e USING (unit_id) GROUP BY seed, is_anomaly""")
def inject_labels(c):
    """Every seed's panel, summed per label."""
    shaken = anomaly.inject_anomalies(_panel(c), seeds=SEEDS)
    return shaken.groupBy("seed", "is_anomaly").agg(
        F.count("*").alias("filas"),
        F.count_distinct("unit_id").alias("unidades"),
        F.round(F.sum("consumo"), 2).alias("consumo"),
    )


@query(f"""WITH {_INJECTED}
SELECT seed, unit_id, ROUND(factor, 9) AS factor FROM etiquetas WHERE is_anomaly""")
def injected_units(c):
    units = c.star.fact.select(F.col("id_ubicacion").alias("unit_id")).distinct()
    labels = anomaly.choose_anomalies(units, "unit_id", 0.03, 0.70, SEEDS)
    return labels.filter("is_anomaly").select("seed", "unit_id", F.round("factor", 9).alias("factor"))


_METRICS = """
curva AS MATERIALIZED (
  SELECT clave, score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, row_number() OVER w AS orden,
    SUM(pos) OVER (PARTITION BY clave) AS p, SUM(neg) OVER (PARTITION BY clave) AS n
  FROM (SELECT clave, score, SUM(label) AS pos, COUNT(*) - SUM(label) AS neg FROM puntos GROUP BY clave, score)
  WINDOW w AS (PARTITION BY clave ORDER BY score DESC)),
areas AS (
  SELECT clave, CAST(SUM(pos * ((n - fp) + neg / 2.0)) AS DOUBLE) / NULLIF(CAST(MAX(p) AS DOUBLE) * CAST(MAX(n) AS DOUBLE), 0) AS roc_auc,
    SUM(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / NULLIF(CAST(MAX(p) AS DOUBLE), 0) AS pr_auc
  FROM curva GROUP BY clave),
avisos AS (
  SELECT clave, COUNT(CASE WHEN r <= p THEN 1 END) AS alerts, COUNT(CASE WHEN r <= p AND label = 1 THEN 1 END) AS tp, MAX(p) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY score DESC, unidad) AS r, SUM(label) OVER (PARTITION BY clave) AS p FROM puntos)
  GROUP BY clave),
medidas AS (
  SELECT clave, alerts, COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(alerts AS DOUBLE), 0), 0.0) AS precision,
    COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(p AS DOUBLE), 0), 0.0) AS recall,
    COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(alerts + p AS DOUBLE), 0), 0.0) AS f1, roc_auc, pr_auc
  FROM avisos JOIN areas USING (clave))"""

def _average_path(n: str) -> str:
    """Mean depth of an unsuccessful search among n points."""
    return f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + 0.5772156649015329e0) - 2e0 * ({n} - 1e0) / {n} END"


def _low_bits(text: str) -> str:
    """Whole number below 2**32 from a text's digest."""
    return f"CAST('0x' || SUBSTR(md5({text}), 1, 8) AS BIGINT)"


def _forest(points: str, trees: int = 300, sample: int = 256) -> str:
    """CTEs up to ``bosque`` (clave, unidad, score): a forest grown level by level over ``points`` (clave, unidad, x)."""
    slot, cut = _low_bits("'0:' || clave || ':' || t || ':slot:' || j"), _low_bits("'0:' || clave || ':' || t || ':cut:' || nodo")
    levels = "".join(f"""
nivel{d + 1} AS MATERIALIZED (SELECT clave, t, m, x, CASE WHEN c IS NULL THEN nodo ELSE 2 * nodo + CAST(x > c AS BIGINT) END AS nodo,
    CASE WHEN c IS NOT NULL AND x > c THEN c ELSE bajo END AS bajo
  FROM nivel{d} JOIN (SELECT clave, t, nodo, CASE WHEN a < b AND length(bin(GREATEST(m, 2) - 1)) > {d} THEN CASE WHEN w >= b THEN a ELSE w END END AS c
    FROM (SELECT *, a + CAST({cut} AS DOUBLE) / 4294967296e0 * (b - a) AS w
      FROM (SELECT clave, t, nodo, MAX(m) AS m, MIN(x) AS a, MAX(x) AS b FROM nivel{d} GROUP BY clave, t, nodo))) USING (clave, t, nodo)),"""
        for d in range((sample - 1).bit_length()))
    return f"""
orden AS MATERIALIZED (SELECT clave, unidad, x, COUNT(*) OVER (PARTITION BY clave) AS n,
    row_number() OVER (PARTITION BY clave ORDER BY md5('0:' || clave || ':' || unidad), unidad) AS r FROM {points}),
tallas AS (SELECT clave, MAX(n) AS n, LEAST({sample}, MAX(n)) AS m FROM orden GROUP BY clave),
nivel0 AS MATERIALIZED (SELECT clave, t, m, x, CAST(1 AS BIGINT) AS nodo, CAST('-inf' AS DOUBLE) AS bajo
  FROM (SELECT clave, t, m, (j * n) // m + {slot} % (((j + 1) * n) // m - (j * n) // m) + 1 AS r
    FROM tallas, (SELECT UNNEST(range({trees})) AS t), (SELECT UNNEST(range({sample})) AS j) WHERE j < m) JOIN orden USING (clave, r)),{levels}
hojas AS (SELECT clave, t, bajo, CAST(length(bin(nodo)) - 1 + ROUND({_average_path("k")}, 9) AS DECIMAL(18,9)) AS camino
  FROM (SELECT clave, t, nodo, MIN(bajo) AS bajo, COUNT(*) AS k FROM nivel{(sample - 1).bit_length()} GROUP BY clave, t, nodo)),
escalera AS MATERIALIZED (SELECT clave, bajo, SUM(paso) OVER (PARTITION BY clave ORDER BY bajo) AS hondo
  FROM (SELECT clave, bajo, SUM(paso) AS paso FROM (SELECT clave, bajo, camino - COALESCE(LAG(camino) OVER (PARTITION BY clave, t ORDER BY bajo), 0) AS paso FROM hojas)
    GROUP BY clave, bajo)),
bosque AS MATERIALIZED (SELECT o.clave, o.unidad, POW(2e0, -(CAST(e.hondo AS DOUBLE) / {trees}e0) / GREATEST({_average_path("m")}, 1e-12)) AS score
  FROM orden o ASOF JOIN escalera e ON o.clave = e.clave AND o.x > e.bajo JOIN tallas g ON g.clave = o.clave)"""


def _outliers(points: str, k: int = 20) -> str:
    """CTEs up to ``factores`` (clave, unidad, score): the k nearest of a value are among the k before and the k after it."""
    return f"""
fila AS MATERIALIZED (SELECT clave, unidad, x, row_number() OVER (PARTITION BY clave ORDER BY x, unidad) AS pos FROM {points}),
cerca AS MATERIALIZED (SELECT * FROM (
  SELECT a.clave, a.unidad, b.unidad AS otra, ABS(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.clave, a.unidad ORDER BY ABS(b.x - a.x), b.x, b.unidad) AS r
  FROM (SELECT *, UNNEST(range(-{k}, {k + 1})) AS salto FROM fila) a JOIN fila b ON a.clave = b.clave AND b.pos = a.pos + a.salto AND a.salto <> 0) WHERE r <= {k}),
alcance AS (SELECT clave, unidad, MAX(d) AS kd FROM cerca GROUP BY clave, unidad),
densidad AS MATERIALIZED (SELECT c.clave, c.unidad, 1e0 / (SUM(GREATEST(a.kd, c.d)) / {k} + 1e-10) AS lrd
  FROM cerca c JOIN alcance a ON a.clave = c.clave AND a.unidad = c.otra GROUP BY c.clave, c.unidad),
factores AS MATERIALIZED (SELECT c.clave, c.unidad, SUM(o.lrd) / {k} / MAX(l.lrd) AS score
  FROM cerca c JOIN densidad o ON o.clave = c.clave AND o.unidad = c.otra JOIN densidad l ON l.clave = c.clave AND l.unidad = c.unidad GROUP BY c.clave, c.unidad)"""


_STANDARD = f"""WITH {_INJECTED},
agitado AS (SELECT e.seed, p.alcaldia, p.unit_id, e.is_anomaly, SUM(CAST(p.consumo AS DOUBLE) * e.factor) AS total
  FROM panel p JOIN etiquetas e USING (unit_id) GROUP BY e.seed, p.alcaldia, p.unit_id, e.is_anomaly),
normal AS MATERIALIZED (SELECT seed AS clave, unit_id AS unidad, (total - mu) / (sigma + 1e-9) AS z, CAST(is_anomaly AS INT) AS label
  FROM agitado JOIN (SELECT seed, alcaldia, AVG(total) AS mu, STDDEV_POP(total) AS sigma FROM agitado GROUP BY seed, alcaldia) USING (seed, alcaldia))"""

_SWEPT = f"""{_STANDARD},
puntos AS MATERIALIZED (SELECT clave, unidad, ABS(z) AS score, label FROM normal),
{_METRICS}"""

_SWEPT_ALL = f"""{_STANDARD},
valores AS MATERIALIZED (SELECT clave, unidad, ROUND(z, 6) AS x FROM normal),{_forest("valores")},{_outliers("valores")},
puntos AS MATERIALIZED (
  SELECT clave || ':{evaluation.DEPLOYED}' AS clave, unidad, ABS(z) AS score, label FROM normal
  UNION ALL SELECT clave || ':{evaluation.FOREST}', unidad, ROUND(score, 9), label FROM bosque JOIN normal USING (clave, unidad)
  UNION ALL SELECT clave || ':{evaluation.LOCAL}', unidad, ROUND(score, 9), label FROM factores JOIN normal USING (clave, unidad)),
{_METRICS}"""
_SEED, _METHOD = "CAST(split_part(clave, ':', 1) AS INTEGER) AS seed", "split_part(clave, ':', 2) AS method"


@query(_SWEPT + """
SELECT clave AS seed, 'A_g (deployed ranking)' AS method, alerts, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
  ROUND(roc_auc, 6) AS roc_auc, ROUND(pr_auc, 6) AS pr_auc FROM medidas""")
def deployed_sweep(c):
    """The deployed ranking over all seeds."""
    return _rounded(evaluation.sweep(_panel(c), SEEDS, methods=[evaluation.DEPLOYED]))


@query(_SWEPT + """
SELECT 'A_g (deployed ranking)' AS method, """ + ", ".join(
    f"ROUND(AVG({m}), 6) AS {m}_mean, ROUND(STDDEV_SAMP({m}), 6) AS {m}_std" for m in evaluation.METRICS)
    + " FROM medidas")
def metric_summary(c):
    results = evaluation.sweep(_panel(c), SEEDS, methods=[evaluation.DEPLOYED])
    summary = evaluation.summarise(results)
    return summary.select("method", *[F.round(n, 6).alias(n) for n in summary.columns if n != "method"])


def _rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in evaluation.METRICS})


@query(_SWEPT_ALL + f"""
SELECT {_SEED}, {_METHOD}, alerts, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
  ROUND(roc_auc, 6) AS roc_auc, ROUND(pr_auc, 6) AS pr_auc FROM medidas""")
def sweep_metrics(c):
    """All three methods over all seeds."""
    return _rounded(evaluation.sweep(_panel(c), SEEDS))


@query(_SWEPT_ALL + f"""
SELECT {_SEED}, {_METHOD}, CAST(MAX(orden) OVER (PARTITION BY clave) - orden AS BIGINT) AS point,
  ROUND(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 9) AS precision, ROUND(CAST(tp AS DOUBLE) / CAST(p AS DOUBLE), 9) AS recall, ROUND(score, 6) AS threshold FROM curva
UNION ALL SELECT {_SEED}, {_METHOD}, CAST(MAX(orden) AS BIGINT), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM curva GROUP BY clave""")
def sweep_curves(c):
    """Precision and recall at every threshold, per seed and method."""
    curves = evaluation.pr_curve(evaluation.sweep_scores(_panel(c), SEEDS), ["seed", "method"])
    return curves.select(
        "seed", "method", "point", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("threshold", 6).alias("threshold")
    )


@query(f"""WITH valores AS MATERIALIZED (SELECT 42 AS clave, alcaldia || '|' || colonia AS unidad, ROUND(z, 6) AS x FROM totales),{_forest("valores")}
SELECT unidad, ROUND(score, 6) AS score FROM bosque""")
def isolation_scores(c):
    scores = _scores(c).select(F.lit(42).alias("seed"), "alcaldia", "colonia", F.round("z", 6).alias("z"))
    named = scores.withColumn("unidad", F.concat_ws("|", "alcaldia", "colonia"))
    return anomaly.isolation_scores(named, "z", "unidad", ["seed"]).select(
        "unidad", F.round("score", 6).alias("score")
    )


@query("""WITH pts AS (SELECT id_ubicacion AS id, ROUND(z, 6) AS v FROM totales),
nb AS MATERIALIZED (SELECT * FROM (
  SELECT a.id, b.id AS nid, ABS(b.v - a.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY ABS(b.v - a.v), b.v, b.id) AS r
  FROM pts a JOIN pts b ON a.id <> b.id) WHERE r <= 20),
kd AS (SELECT id, MAX(d) AS kd FROM nb GROUP BY id),
lrd AS (SELECT nb.id, 1.0 / (SUM(GREATEST(kd.kd, nb.d)) / 20 + 1e-10) AS lrd FROM nb JOIN kd ON kd.id = nb.nid GROUP BY nb.id)
SELECT u.alcaldia, u.colonia, ROUND(SUM(o.lrd) / 20 / MAX(l.lrd), 5) AS lof
FROM nb JOIN lrd o ON o.id = nb.nid JOIN lrd l ON l.id = nb.id JOIN dim_ubicacion u ON u.id_ubicacion = nb.id
GROUP BY u.alcaldia, u.colonia, nb.id""")
def lof_1d(c):
    values = _scores(c).select("alcaldia", "colonia", F.round("z", 6).alias("z"))
    return anomaly.lof(values, "z", k=20).select("alcaldia", "colonia", F.round("lof", 5).alias("lof"))


# Scores and truth of another shape: text length against a quality label, per language.
_TEXTS = f"""WITH puntos AS MATERIALIZED (
  SELECT d.lang AS clave, d.doc_id AS unidad, d.n_chars AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
{_METRICS}"""


def _texts(c):
    return c.table("documents").join(c.table("labels"), "doc_id").select(
        "lang", "doc_id", F.col("n_chars").alias("score"), F.col("quality").alias("label")
    )


@query(_TEXTS + "SELECT clave AS lang, alerts, precision, recall, f1 FROM medidas")
def precision_at_alerts(c):
    return evaluation.precision_recall_f1(_texts(c), ["lang"], "doc_id")


@query(_TEXTS + """
SELECT clave AS lang, CAST(MAX(orden) OVER (PARTITION BY clave) - orden AS BIGINT) AS point, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(p AS DOUBLE), 0), 1.0) AS recall, CAST(score AS DOUBLE) AS threshold FROM curva
UNION ALL SELECT clave, CAST(MAX(orden) AS BIGINT), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM curva GROUP BY clave""")
def pr_curve(c):
    return evaluation.pr_curve(_texts(c), ["lang"])


@query(_TEXTS + "SELECT clave AS lang, ROUND(roc_auc, 9) AS roc_auc FROM areas")
def roc_auc(c):
    return evaluation.roc_auc(_texts(c), ["lang"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query(_TEXTS + "SELECT clave AS lang, ROUND(pr_auc, 9) AS pr_auc FROM areas")
def average_precision(c):
    return evaluation.average_precision(_texts(c), ["lang"]).withColumn("pr_auc", F.round("pr_auc", 9))


@query("""
SELECT event_type, COUNT(*) AS n, ROUND(AVG(value), 9) AS mean,
  list_extract(list_sort(list(value)), CAST(CASE WHEN FLOOR(CAST(0.95 AS DOUBLE) * COUNT(*)) = 0 THEN COUNT(*) ELSE FLOOR(CAST(0.95 AS DOUBLE) * COUNT(*)) END AS BIGINT)) AS p95
FROM events GROUP BY event_type""")
def latency_summary(c):
    rows = evaluation.latency_summary(c.table("events"), ["event_type"], "value")
    return rows.withColumn("mean", F.round("mean", 9))
