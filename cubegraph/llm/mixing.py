"""Mixing sources to target weights by iterative proportional fitting.

The corpus is reduced to cells of (source, lang, topic) with their token mass. The
mass is raked: each margin in turn is scaled to its target shares, over and over, so
that all three hold at once while the cells keep their odds. The sample has a budget, a share of all
tokens: a target beyond what a category holds, and a cell beyond its own mass, is kept whole,
and the others make up for it. A cell's fitted mass over its own mass is the probability with
which a document stays, so a tiny cell takes no more than its tokens from the rest. Without a
budget the cell of the largest weight alone decides how much stays. Every step is a grouped sum
and a join of cells, so the number of sources bounds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import join_on, read, register, store, superseded, text_of

MARGINS = ("source", "lang", "topic")
ROUNDS = 12
SHARE = 0.5
NEARLY = 1e-9
WORD = r"[^\x20\x09-\x0D]+"
DRAW_BITS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def characters_of(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A class of content that text alone decides: table, markup, note, article or book."""
    return (
        F.when(10 * characters_of(text, "|") >= words, "table")
        .when(10 * characters_of(text, "#*$%&<>") >= words, "markup")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("book")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; tokens are words, and a text counts one more for its end."""
    text = text_of(docs)
    words = docs.select("doc_id", "source", "lang", text.alias("text"), word_count(text).alias("words"))
    return words.select(
        "doc_id", "source", "lang", topic_of(F.col("text"), F.col("words")).alias("topic"), (F.col("words") + 1).alias("n_tokens")
    )


def tempered_targets(cells: DataFrame, margin: str) -> DataFrame:
    """(margin, share): shares in proportion to each category's mass to the power 3/4."""
    root = F.sqrt(F.sum("mass"))
    mass = cells.groupBy(margin).agg((root * F.sqrt(root)).alias("root"))
    total = mass.agg(F.sum("root").alias("total"))
    return mass.join(F.broadcast(total)).select(margin, (F.col("root") / F.col("total")).alias("share"))


def scale_to(rows: DataFrame, size: Column, most: Column, budget: float) -> float:
    """The k for which least(most, k * size) adds up to ``budget``, or the least one that fills every row.

    The sum is concave in k, so Newton's steps from zero only rise and end where no further row fills.
    """
    k = 0.0
    while True:
        full = size * k >= most
        got = rows.agg(F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, size)).alias("open")).first()
        step = (budget - (got["full"] or 0.0)) / got["open"] if got["open"] else k
        if step <= k * (1 + 1e-12):
            return k
        k = step


def bounded_targets(cells: DataFrame, margin: str, target: DataFrame, budget: float) -> DataFrame:
    """(margin, share): tokens in proportion to ``target``, at most what a category holds, ``budget`` in all."""
    room = cells.groupBy(margin).agg(F.sum("mass").cast("double").alias("room"))
    rows = store(join_on(room, target, [margin]), f"room-{margin}")
    k = scale_to(rows, F.col("share"), F.col("room"), budget)
    return rows.select(margin, F.least("room", F.col("share") * k).alias("share"))


def raking_ratio(share: Column, bounded: bool) -> Column:
    """What scales a category to its ``share``; where cells keep at most their mass, those that do are left out."""
    if not bounded:
        return share / F.sum("fitted")
    is_full = F.col("fitted") >= F.col("mass") * (1 - NEARLY)  # a cell filled up to rounding is full
    full = F.coalesce(F.sum(F.when(is_full, F.col("mass"))), F.lit(0.0))
    rest = F.coalesce(F.sum(F.when(~is_full, F.col("fitted"))), F.lit(0.0))
    return F.when((share > full) & (rest > 0), (share - full) / rest).otherwise(share / (full + rest))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, bounded: bool = False) -> DataFrame:
    """``cells`` with ``fitted``: shares that match every target, from the cells' own mass.

    A category without a target, or without cells, takes no part; the shares that do are scaled to one. If ``bounded``,
    targets are tokens and match the sums of least(fitted, mass).
    """
    fitted, last = cells.withColumn("fitted", F.col("mass").cast("double")), []
    for margin, target in targets.items():
        fitted = join_on(fitted, target.withColumnRenamed("share", f"share_{margin}"), [margin])
    for _ in range(rounds):
        for margin in targets:
            share = F.first(f"share_{margin}")  # one value for each category
            ratio = fitted.groupBy(margin).agg(raking_ratio(share, bounded).alias("ratio"))
            fitted = join_on(fitted, ratio, [margin]).withColumn("fitted", F.col("fitted") * F.col("ratio")).drop("ratio")
            fitted = superseded(store(fitted, "raked"), *last)  # read twice by the next step
            last = [fitted]
    return fitted.select(*cells.columns, "fitted")


def fitted_to_budget(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, share: float) -> DataFrame:
    """``cells`` that every target names, with ``probability``: the tokens kept are ``share`` of theirs."""
    for target in targets.values():
        cells = join_on(cells, target.drop("share"), target.drop("share").columns)
    cells = store(cells, "cells-with-targets")
    budget = share * (cells.agg(F.sum("mass")).first()[0] or 0)
    bounded = {m: store(bounded_targets(cells, m, t, budget), f"bounded-{m}") for m, t in targets.items()}
    fitted = raked(cells, bounded, rounds, bounded=True)
    k = scale_to(fitted, F.col("fitted"), F.col("mass").cast("double"), budget)
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("fitted") * k / F.col("mass")))


def probabilities(
    rows: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = SHARE
) -> DataFrame:
    """source, lang, topic, weight, probability of each cell of ``rows`` (see ``described``).

    ``share`` of the tokens of all cells with targets stays; None scales by the largest weight.
    """
    cells = store(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("mass")), "cells")
    targets = targets or {m: store(tempered_targets(cells, m), f"target-{m}") for m in MARGINS}
    if share is not None:
        kept = store(fitted_to_budget(cells, targets, rounds, share), "fitted")
        ratio = F.col("probability") / F.col("tokens")
        tokens = kept.agg(F.sum(F.col("mass") * F.col("probability")).alias("tokens"))
        total = cells.agg(F.sum("mass").cast("double").alias("total"))
        return store(
            kept.join(F.broadcast(tokens)).join(F.broadcast(total)).select(
                *MARGINS, F.round(ratio * F.col("total"), 6).alias("weight"), F.round("probability", 9).alias("probability")
            ),
            "probabilities",
        )
    fitted = raked(cells, targets, rounds)
    weighted = fitted.select(*MARGINS, (F.col("fitted") / F.col("mass")).alias("ratio"))
    scale = weighted.agg(F.max("ratio").alias("largest"))
    total = cells.agg(F.sum("mass").cast("double").alias("total"))
    return store(
        weighted.join(F.broadcast(scale)).join(F.broadcast(total)).select(
            *MARGINS,
            F.round(F.col("ratio") * F.col("total"), 6).alias("weight"),
            F.round(F.col("ratio") / F.col("largest"), 9).alias("probability"),
        ),
        "probabilities",
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that the id alone decides."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << DRAW_BITS))


def mixed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = SHARE
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled: a row per document.

    A null source or lang is a category of its own; a null text counts as empty. Rows with
    one doc_id (or none) share a draw. A document of a cell without a target has
    probability 0. An empty table gives an empty result. Only doc_id, text, source and lang are
    read. ``share`` is that of ``probabilities``.
    """
    rows = store(described(docs), "described")  # texts are read once
    cells = probabilities(rows, targets, rounds, share)
    chance = F.coalesce(F.col("probability"), F.lit(0.0))
    return join_on(rows, cells, list(MARGINS), "left").select(
        "doc_id", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        chance.alias("probability"), (draw(F.col("doc_id")) < chance).alias("sampled"),
    )


def sampled(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = SHARE
) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with all their columns."""
    cells = probabilities(store(described(docs), "described"), targets, rounds, share)
    cells = cells.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("probability").alias("__probability"))
    text = text_of(docs)
    rows = docs.withColumn("__words", word_count(text)).withColumn("__cell", topic_of(text, F.col("__words")))
    match = (
        docs["source"].eqNullSafe(cells["__source"]) & docs["lang"].eqNullSafe(cells["__lang"]) & (F.col("__cell") == cells["__topic"])
    )
    return rows.join(cells, match).filter(draw(F.col("doc_id")) < F.col("__probability")).select(*docs.columns)


def _sql() -> str:
    steps = [
        """d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN 10 * (length(t) - length(replace(t, '|', ''))) >= n_tokens - 1 THEN 'table'
    WHEN 10 * (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g'))) >= n_tokens - 1 THEN 'markup'
    WHEN n_tokens <= 100 THEN 'note' WHEN n_tokens <= 1000 THEN 'article' ELSE 'book' END AS topic
  FROM (SELECT *, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens
    FROM (SELECT *, COALESCE(text, '') AS t FROM documents)))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(SUM(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, r * SQRT(r) / SUM(r * SQRT(r)) OVER () AS share FROM (SELECT {m}, SQRT(SUM(mass)) AS r FROM c GROUP BY {m}))"
        )
    steps.append(f"b AS MATERIALIZED (SELECT {SHARE} * SUM(mass) AS budget FROM c)")
    for m in MARGINS:
        # The k for which the least of room and k * share adds up to the budget: categories fill up in the order of room / share.
        steps.append(f"""r_{m} AS MATERIALIZED (SELECT {m}, room, share, COALESCE(SUM(room) OVER (ORDER BY room / share, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    SUM(share) OVER (ORDER BY room / share DESC, {m} DESC) AS open_from FROM (SELECT x.{m}, room, share FROM (SELECT {m}, SUM(mass) AS room FROM c GROUP BY {m}) x JOIN t_{m} t ON x.{m} IS NOT DISTINCT FROM t.{m})),
k_{m} AS MATERIALIZED (SELECT MAX((budget - full_before) / open_from) AS k FROM r_{m}, b),
s_{m} AS MATERIALIZED (SELECT {m}, LEAST(room, share * k) AS share FROM r_{m}, k_{m})""")
    steps.append("w0 AS MATERIALIZED (SELECT *, mass AS fitted FROM c)")
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(
                f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, mass, fitted * CASE WHEN share > f AND r > 0 THEN (share - f) / r ELSE share / (f + r) END AS fitted"
                f" FROM (SELECT w.*, share, COALESCE(SUM(CASE WHEN fitted >= mass * (1 - {NEARLY}) THEN mass END) OVER (PARTITION BY w.{m}), 0) AS f,"
                f" COALESCE(SUM(CASE WHEN fitted < mass * (1 - {NEARLY}) THEN fitted END) OVER (PARTITION BY w.{m}), 0) AS r"
                f" FROM w{n} w JOIN s_{m} t ON w.{m} IS NOT DISTINCT FROM t.{m}))"
            )
            n += 1
    steps.append(f"""rw AS MATERIALIZED (SELECT *, COALESCE(SUM(mass) OVER (ORDER BY mass / fitted, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    SUM(fitted) OVER (ORDER BY mass / fitted DESC, source DESC, lang DESC, topic DESC) AS open_from FROM w{n}),
kw AS MATERIALIZED (SELECT MAX((budget - full_before) / open_from) AS k FROM rw, b),
pr AS MATERIALIZED (SELECT source, lang, topic, mass, LEAST(1, fitted * k / mass) AS probability FROM w{n}, kw)""")
    return (
        "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, weight, ROUND(p.probability, 9) AS probability,
  CAST(('0x' || substr(md5(COALESCE(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < ROUND(p.probability, 9) AS sampled
FROM d JOIN (SELECT source, lang, topic, probability, ROUND(probability / (SELECT SUM(mass * probability) FROM pr) * (SELECT SUM(mass) FROM c), 6) AS weight FROM pr) p
  ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""
    )


@register(_sql())
def op9_mixing_weights(spark, sf_dir):
    return mixed(read(spark, sf_dir, "documents"))
