"""A trigram index over folded names: a search reads the postings of its trigrams, not all names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.functions.text import contains_folded, fold
from cubegraph.session import materialise_buckets, materialise_table

GRAM = 3
#: Names per bucket of the stored names, and the most buckets.
BUCKET_NAMES, MOST_BUCKETS = 1_000_000, 4096


def grams(text: Column) -> Column:
    """Distinct stretches of three letters of a text; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))))


@dataclass(frozen=True)
class NameIndex:
    """Rows by key, and postings (gram, key) sorted by gram, so that a scan for a few grams skips the files' other parts."""

    rows: DataFrame
    postings: DataFrame
    key: str
    name: str

    def search(self, text: str) -> DataFrame:
        """Rows whose folded name holds the folded text; a text of fewer than three letters reads all names."""
        wanted = self.rows.sparkSession.range(1).select(F.explode(grams(fold(F.trim(F.lit(text))))).alias("gram"))
        found = [r["gram"] for r in wanted.collect()]  # as many as the text has letters
        holds = contains_folded(F.col(self.name), text)
        if not found:
            return self.rows.filter(holds)
        hits = self.postings.filter(F.col("gram").isin(found)).groupBy(self.key).agg(F.count("*").alias("_n"))
        likely = hits.filter(F.col("_n") == len(found)).select(self.key)
        return self.rows.join(likely, self.key, "left_semi").filter(holds)


def index_names(df: DataFrame, key: str, name: str, label: str = "names") -> NameIndex:
    """An index of ``df``, whose ``key`` is unique."""
    rows = materialise_table(df, label)
    buckets = min(max(-(-rows.count() // BUCKET_NAMES), 1), MOST_BUCKETS)
    rows = materialise_buckets(rows, f"{label}-rows", key, buckets)
    spread = rows.select(F.explode(grams(fold(F.col(name)))).alias("gram"), key)
    return NameIndex(rows, materialise_table(spread.orderBy("gram", key), f"{label}-grams"), key, name)
