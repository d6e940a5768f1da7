"""Small relational verbs shared by the other modules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def values_df(spark: SparkSession, rows: Sequence[tuple], schema) -> DataFrame:
    """Inline relation of literal rows."""
    return spark.createDataFrame(list(rows), schema)


def require_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def missing(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` without a partner (NOT EXISTS)."""
    return left.join(right, on, "left_anti")


def join_one_to_one(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails while running if either side repeats a key."""
    on = list(on)

    def checked(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in on]
        grouped = df.groupBy(*on).agg(
            F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in others]
        )
        message = F.lit(f"keys are not unique in the {side} relation")
        single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )
        return grouped.filter(single).drop("_n")

    return checked(a, "left").join(checked(b, "right"), on)


def first_match(criteria: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first criterion a row meets."""
    (name, condition), *rest = criteria
    chain = F.when(condition, F.lit(name))
    for name, condition in rest:
        chain = chain.when(condition, F.lit(name))
    return chain.otherwise(F.lit(otherwise)) if otherwise else chain


def ensure_columns(df: DataFrame, schema) -> DataFrame:
    """Add the fields of ``schema`` that ``df`` lacks, as nulls."""
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns]
    return df.select("*", *added)


def insert_ignore(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Target plus the new rows whose key it does not hold yet."""
    fresh = new.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def numeric_columns(df: DataFrame, order: Sequence[str], sample: int = 30) -> DataFrame:
    """One row per column: whether the displayed head of the result looks numeric.

    Looks at the first ``sample`` rows in ``order``; missing values pass.
    """
    head = df.orderBy(*order).limit(sample)
    flags = head.agg(
        *[
            F.coalesce(
                F.bool_and(
                    F.coalesce(
                        (F.col(c).cast("string") == "")
                        | F.col(c).cast("string").rlike(r"^-?\d+(\.\d+)?$"),
                        F.lit(True),
                    )
                ),
                F.lit(True),
            ).alias(c)
            for c in df.columns
        ]
    )
    return flags.unpivot([], df.columns, "column_name", "is_numeric")
