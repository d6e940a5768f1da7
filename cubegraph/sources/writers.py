"""Writers: tables, the mart export, triples and curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cubegraph.functions.dates import iso_date
from cubegraph.functions.text import escape_literal
from cubegraph.operators.marts import MART_COLUMNS, mart_order
from cubegraph.operators.ordering import with_serial, with_surrogate_key
from cubegraph.operators.quality import validate_export
from cubegraph.operators.retrieval import catalogue
from cubegraph.sources.readers import DIALECT
from cubegraph.sources.schemas import CORRELATION_ROW, MART_ROW

#: Rows of a compressed file, which one task reads.
FILE_ROWS = 250_000

def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None before the first load."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _largest(stored: DataFrame | None, key: str) -> int:
    return 0 if stored is None else stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("k")).first()["k"]


def load_dim(df: DataFrame, path: str, order: Sequence[str], key: str) -> DataFrame:
    """Append the members a dimension does not hold yet; their keys go on from the largest stored one."""
    spark = df.sparkSession
    stored = _stored(spark, path)
    fresh = df.dropDuplicates(list(order))
    if stored is not None:
        known = stored.select(*[F.col(c).alias(f"_known_{c}") for c in order])
        same = [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in order]
        fresh = fresh.join(known, reduce(lambda a, b: a & b, same), "left_anti")
    numbered = with_surrogate_key(fresh, order, key)
    numbered.withColumn(key, F.col(key) + F.lit(_largest(stored, key))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def load_fact(df: DataFrame, path: str, key: str, batch: str | None = None) -> DataFrame:
    """Append a batch of facts; keys are unique over all batches, as each begins above the largest stored one.

    A named batch is stored under its name, in a column ``batch``: loading it again replaces its rows and no others, and a load that
    fails leaves none, as its files only move into place once all are written. A table takes named batches or none.
    """
    spark = df.sparkSession
    largest = _largest(_stored(spark, path), key)
    numbered = with_serial(df, key).withColumn(key, F.col(key) + F.lit(largest))
    if batch is None:
        numbered.write.mode("append").parquet(path)
        return spark.read.parquet(path)
    writer = numbered.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(path)
    fields = [f for f in spark.read.parquet(path).schema if f.name != "batch"]
    return spark.read.schema(StructType([*fields, StructField("batch", StringType())])).parquet(path)


def drop_staging(spark: SparkSession, names: Sequence[str]) -> None:
    """Drop views and tables if they exist."""
    for name in names:
        if not spark.catalog.dropTempView(name):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def _number(column: str) -> Column:
    return F.round(F.col(column).cast("double"), 2).alias(column)


def mart_rows(mart: DataFrame, round_coordinates: bool = False) -> DataFrame:
    """Mart rows as exchanged: ISO dates, measures at two places, nulls kept.

    Coordinates keep six places unless they are to be rounded like measures.
    """
    columns = []
    for field in MART_ROW:
        name = field.name
        if name == "fecha":
            columns.append(iso_date(F.col(name)).alias(name))
        elif name in ("latitud", "longitud") and not round_coordinates:
            columns.append(F.col(name).cast("double").alias(name))
        elif field.dataType.typeName() == "double":
            columns.append(_number(name))
        else:
            columns.append(F.col(name).cast(field.dataType).alias(name))
    return mart.orderBy(*mart_order()).select(*columns)


def correlation_rows(corr: DataFrame) -> DataFrame:
    return corr.orderBy("anio", "bimestre").select(
        *[
            _number(f.name)
            if f.dataType.typeName() == "double"
            else F.coalesce(F.col(f.name), F.lit(0)).cast(f.dataType).alias(f.name)
            for f in CORRELATION_ROW
        ]
    )


def export_mart(
    mart: DataFrame, corr: DataFrame, path: str, validate: bool = True, dry_run: bool = False,
    min_boroughs: int = 16, compression: str = "none",
) -> list[str]:
    """Write mart rows, correlation and catalogue as JSON lines, once they validate.

    Returns the problems found; with any, nothing is written. A dry run stops
    after the validation. With ``compression`` the mart's rows, whose text is many times the mart's size, are written in
    compressed files of bounded length, as such a file cannot be split.
    """
    problems = []
    if validate:
        missing = [f"missing column {c}" for c in MART_COLUMNS if c not in mart.columns]
        if missing:
            return missing
        found = validate_export(mart, corr, mart_order(), min_boroughs).collect()  # five at most
        problems = [f"{r.problem}: {r.n}" for r in found]
    if problems or dry_run:
        return problems
    rows = mart_rows(mart).write.mode("overwrite")
    if compression != "none":
        rows = rows.option("maxRecordsPerFile", FILE_ROWS)
    rows.json(f"{path}/consumo_colonia", compression=compression, ignoreNullFields=False)
    correlation_rows(corr).write.mode("overwrite").json(f"{path}/correlacion", ignoreNullFields=False)
    catalogue(mart).write.mode("overwrite").partitionBy("kind").json(f"{path}/catalogo")
    return []


def ntriples_line() -> Column:
    """One triple as a line of text."""
    s, p, o, kind, datatype, lang = (
        F.col(c) for c in ("s", "p", "o", "o_kind", "datatype", "lang")
    )
    subject = F.when(s.startswith("_:"), s).otherwise(F.concat(F.lit("<"), s, F.lit(">")))
    suffix = (
        F.when(lang.isNotNull(), F.concat(F.lit("@"), lang))
        .when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">")))
        .otherwise(F.lit(""))
    )
    quoted = F.concat(F.lit('"'), escape_literal(o), F.lit('"'), suffix)
    target = (
        F.when(kind == "literal", quoted)
        .when(kind == "bnode", o)
        .otherwise(F.concat(F.lit("<"), o, F.lit(">")))
    )
    return F.concat(subject, F.lit(" <"), p, F.lit("> "), target, F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line per triple; every task writes its own part."""
    triples.select(ntriples_line().alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text in the readers' dialect; fields with line breaks need a multiline reader."""
    df.write.mode("overwrite").option("header", True).options(**DIALECT).csv(path)
