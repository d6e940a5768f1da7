"""Quality rules as a short-circuit cascade, ordered by rejection per cost; Spark expressions only.

Each rule is a measure of the whole text and a condition on measures. On a bounded
sample every rule is timed and its share of rejected texts taken; rules run in
descending order of rejections per second, and a text that one rule rejects is not shown
to the next (nested CASE). The order changes what is computed, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import read, register, store, text_of
from cubegraph.llm.mixing import characters_of

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bound of the sample on which cost and selectivity are estimated.
SAMPLE_DOCS = 1500


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS), "")


def lines_of(text: Column) -> Column:
    """The \\n-separated lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Only where two are equal are the hashes
    sorted with their places, so that equal ones become neighbours.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            again = F.filter(
                s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            )
            spread = F.flatten(F.transform(again["i"], lambda i: F.array(i, i + 1, i + 2)))
            return F.size(F.array_distinct(spread))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(placed, count)).otherwise(0)

    return F.when(F.size(words) >= 4, bound(hashes, covered)).otherwise(0).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words_of(t)).cast("long"),
    "word_chars": lambda t: F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
    "n_symbols": lambda t: characters_of(t, SYMBOLS),
    "n_lines": lambda t: F.size(lines_of(t)).cast("long"),
    "n_dup_lines": lambda t: bound(lines_of(t), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    "n_repeat_words": lambda t: bound(words_of(t), repeated_words),
    "n_upper": lambda t: (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``condition`` of the measures it needs holds."""

    name: str
    needs: tuple[str, ...]
    condition: Callable[..., Column]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("upper_case", ("n_upper", "word_chars"), lambda u, c: 2 * u > c),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 3 * n) | (c > 10 * n)),
)


def rejects(rule: Rule, measure: Callable[[str], Column]) -> Column:
    return rule.condition(*[measure(n) for n in rule.needs])


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = SAMPLE_DOCS) -> list[Estimate]:
    """Time and rejected share of each rule over about ``most`` documents, chosen by a hash of the id."""
    n = docs.count()
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = docs.select("doc_id", text_of(docs).alias("text")).filter(spot < most / max(n, 1)).limit(2 * most)
    sample = store(chosen.select("text"), "quality-sample")
    size = max(sample.count(), 1)
    found = []
    for rule in rules:
        test = sample.filter(rejects(rule, lambda m: MEASURES[m](F.col("text"))))
        test.count()  # compiled and warm before it is timed
        start = time.perf_counter()
        rejected = test.count()
        found.append(Estimate(rule, time.perf_counter() - start, rejected / size))
    return found


def ordered(found: list[Estimate]) -> tuple[Rule, ...]:
    return tuple(e.rule for e in sorted(found, key=lambda e: (-e.worth, e.seconds, e.rule.name)))


def verdict(rules: tuple[Rule, ...], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    chain = None
    for rule in rules:
        test, name = rejects(rule, measure), F.lit(rule.name)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return F.lit(None).cast("string") if chain is None else chain


def cascaded(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule, in order of worth, that rejects the text."""
    rules = rules or ordered(estimates(docs))
    text = text_of(docs)
    return docs.withColumn("rejected_by", verdict(rules, lambda m: MEASURES[m](text)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row per row.

    A null text counts as empty, has no words and fails. Rows that repeat are
    judged each on its own, and a null doc_id is handed through. An empty table gives an empty
    result. Only doc_id and text are read.
    """
    rules = ordered(estimates(docs))
    text = docs.select("doc_id", text_of(docs).alias("text"))
    # Both lists are bound to the measures made of them: a caller's filter that is pushed down here repeats a
    # measure, but never splits the text again inside it.
    of_words = bound(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    of_lines = bound(
        lines_of(F.col("text")),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    lists = text.select("doc_id", "text", of_words.alias("w"), of_lines.alias("l"))
    measures = lists.select(
        "doc_id", "text", "w.*", "l.*",
        MEASURES["word_chars"](F.col("text")).alias("word_chars"), MEASURES["n_symbols"](F.col("text")).alias("n_symbols"),
    )
    known = lambda m: F.col(m) if m in measures.columns else MEASURES[m](F.col("text"))
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rejects(rule, known)
    return measures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), verdict(rules, known).isNull().alias("kept"),
    )


@register(
    r"""
WITH d AS (SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM g, (SELECT UNNEST([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    COALESCE(n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars
    OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM m"""
)
def op8_quality_rules(spark, sf_dir):
    return judged(read(spark, sf_dir, "documents"))
