"""What the operators of this subpackage share: tables, stored results, row keys, registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubegraph.session import end_table, materialise_table, tune

WORD_BREAKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{table}.parquet")


def store(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again."""
    return materialise_table(df, f"llm-{label}", partition_by, codec=None)


def made_of(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads only some stored tables; they end when it is superseded."""
    df.tables = tables
    return df


def united(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of the same columns as one."""
    return made_of(reduce(DataFrame.unionByName, tables), *tables)


def superseded(new: DataFrame, *old: DataFrame) -> DataFrame:
    """A stored table, after the stored ones it was made of have been deleted."""
    for df in old:
        for table in vars(df).get("tables", (df,)):
            end_table(table)
    return new


#: Rows of a few fixed-width columns that may be broadcast: some tens of MB.
MOST_BROADCAST = 300_000


def bounded(stored: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A stored table of fixed-width rows, to be broadcast if it has at most ``most``; a larger one is joined by an exchange."""
    return F.broadcast(stored) if stored.count() <= most else stored


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def text_of(docs: DataFrame) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's digest; (doc_id, digest) names a row even where ids are null or repeat."""
    text = text_of(docs)
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha"))


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, null pairing with null; the result has the left's columns, then the right's others."""
    alias = {n: f"__right_{n}" for n in names}
    other = right.select(*[F.col(n).alias(alias.get(n, n)) for n in right.columns])
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(alias[n]))
    joined = left.join(other, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*alias.values())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def tuned(spark: SparkSession) -> SparkSession:
    """Adaptive execution, and Arrow batches that stay small where texts are long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


@dataclass(frozen=True)
class LlmQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(tuned(spark), sf_dir)


REGISTERED: dict[str, LlmQuery] = {}


def register(sql: str | None = None):
    """File a function (spark, folder) under its name, with its SQL where there is one."""

    def add(build):
        REGISTERED[build.__name__] = LlmQuery(build.__name__, build, sql)
        return build

    return add
