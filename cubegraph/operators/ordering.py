"""Keys, running totals, ranks, sorts and pages that never need one big task.

A window without a partition column sends every row to one task. The global
variants here sort by range instead, store the sorted rows once, and carry the
totals of earlier range partitions over as offsets; the offset table has one row
per range partition and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubegraph.session import materialise_table

Order = Sequence[Column | str]


def _columns(order: Order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _stored_in_order(df: DataFrame, order: Order, label: str) -> DataFrame:
    """``df`` sorted by range and stored, with the number of its range and its place there."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = df.orderBy(*_columns(order)).withColumn("_part", F.spark_partition_id()).withColumn("_local", local)
    return materialise_table(numbered, label)


def enumerate_rows(df: DataFrame, order: Order, name: str = "n", start: int = 1) -> DataFrame:
    """Dense numbering 1..n in ``order``, which must be unique over the rows."""
    stored = _stored_in_order(df, order, f"numbered-{name}")
    sizes = stored.groupBy("_part").agg((F.max("_local") + 1).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        stored.join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn(name, (F.col("_offset") + F.col("_local") + F.lit(start)).cast("long"))
        .drop("_part", "_local", "_offset")
    )


def with_surrogate_key(df: DataFrame, order: Order, name: str) -> DataFrame:
    """Deterministic dense key of a dimension, by the order of its natural key."""
    return enumerate_rows(df, order, name).select(name, *df.columns)


def with_serial(df: DataFrame, name: str) -> DataFrame:
    """Unique, gappy row key without a shuffle; fixed once the rows are stored."""
    return df.select((F.monotonically_increasing_id() + 1).alias(name), "*")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Order, totals: dict[str, Column | str]
) -> DataFrame:
    """Cumulative sums per key in ``order`` (unique per key), for keys of any size.

    ``totals`` maps a new column to the value it accumulates; ``<column>_all``
    holds the key's whole sum.
    """
    by = list(by)
    values = {n: F.col(v) if isinstance(v, str) else v for n, v in totals.items()}
    staged = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    stored = materialise_table(
        staged.orderBy(*by, *_columns(order)).withColumn("_part", F.spark_partition_id()), "running"
    )
    sums = stored.groupBy(*by, "_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values]
    )
    parts = W.partitionBy(*by)
    before = parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(parts).alias(f"{n}_all") for n in values],
    )
    inside = (
        W.partitionBy(*by, "_part")
        .orderBy(*_columns(order))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    within = stored.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_w_{n}") for n in values])
    # The window left the rows partitioned by the join's keys: only offsets move.
    return within.join(offsets, [*by, "_part"]).select(
        *df.columns,
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in values],
        *[f"{n}_all" for n in values],
    )


def hash_ranks(
    df: DataFrame, by: Sequence[str], digest: str, name: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Dense rank per key in the order of a hexadecimal digest of a unique value.

    Digests spread evenly over their three leading digits, so 4,096 buckets per
    key rank in parallel and need no sampled sort.
    """
    by = list(by)
    staged = df.withColumn("_bucket", F.substring(digest, 1, 3))
    sizes = staged.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(digest, *tie)
    return (
        staged.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def top_k_per_key(df: DataFrame, key: Sequence[str] | str, order: Order, k: int) -> DataFrame:
    """First ``k`` rows per key; Spark cuts each map task to ``k`` rows before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*_columns(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


@dataclass(frozen=True)
class OrderedRows:
    """A relation stored in an order, and an index of its files: how many rows come before each.

    A page reads the index and the files it lies in, whatever its offset.
    """

    schema: StructType
    files: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def total(self) -> DataFrame:
        """One row: how many rows there are."""
        return self.files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` .. ``offset + limit``; the driver learns the few files they are in."""
        last = offset + limit
        inside = (F.col("before") < last) & (F.col("before") + F.col("size") > offset)
        parts = []
        for f in self.files.filter(inside).orderBy("before").collect():
            rows = self.spark.read.schema(self.schema).parquet(f["file"])
            wanted = F.col("_local").between(offset - f["before"], last - f["before"] - 1)
            parts.append(rows.filter(wanted).withColumn("_row", F.col("_local") + F.lit(f["before"])))
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("_part", "_local")
        return reduce(DataFrame.unionByName, parts).orderBy("_row").drop("_row", "_part", "_local")


def store_ordered(df: DataFrame, order: Order, label: str) -> OrderedRows:
    """``df`` sorted by range and stored, a file per range, with the index of its files."""
    stored = _stored_in_order(df, order, label)
    sizes = stored.groupBy("_part", F.input_file_name().alias("file")).agg(F.count("*").alias("size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = sizes.select("file", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return OrderedRows(stored.schema, materialise_table(files, f"{label}-files"))


def page(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of the ordered relation, as a top-k: each task keeps its best rows."""
    return df.orderBy(*_columns(order)).offset(offset).limit(limit)


def numbered_page(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """The same page for deep offsets: the relation is sorted by range and stored with row numbers,
    and only the page's rows are gathered. ``order`` must be unique over the rows."""
    numbered = enumerate_rows(df, order, "_row")
    wanted = F.col("_row").between(offset + 1, offset + limit)
    return numbered.filter(wanted).orderBy("_row").drop("_row")


def top(df: DataFrame, order: Order, n: int) -> DataFrame:
    return df.orderBy(*_columns(order)).limit(n)


def top_with_total(df: DataFrame, order: Order, n: int) -> tuple[DataFrame, DataFrame]:
    """The displayed head and the one-row size of the whole result."""
    return top(df, order, n), df.agg(F.count("*").alias("total"))


def page_info(total: DataFrame, size: int, page_no: int) -> DataFrame:
    """From, to, page and page count of a requested page over a one-row total.

    ``page_no`` counts from 1 and is clamped to the existing pages.
    """
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long")
    staged = total.select(
        F.col("total").cast("long"),
        pages.alias("pages"),
        F.least(F.greatest(F.lit(1), F.lit(page_no)), pages).cast("long").alias("page"),
    )
    first = (F.col("page") - 1) * size
    return staged.select(
        "total",
        "pages",
        "page",
        F.when(F.col("total") == 0, F.lit(0)).otherwise(first + 1).cast("long").alias("row_from"),
        F.least(F.col("page") * size, F.col("total")).cast("long").alias("row_to"),
        (F.col("page") == 1).alias("is_first"),
        (F.col("page") >= F.col("pages")).alias("is_last"),
    )


def minmax_scale(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """``(x − min)/(max − min)`` over the relation; a zero range divides by 1."""
    low = df.agg(F.min(column)).scalar()
    spread = (df.agg(F.max(column)).scalar() - low).cast("double")
    width = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return df.withColumn(name, (F.col(column) - low).cast("double") / width)
