"""The two source relations read from order tables instead of files.

Order lines play the readings, orders the sub-daily climate series, customers and
nations the neighbourhoods and boroughs, the order priority the ordinal level
(``4-NOT SPECIFIED`` is a missing level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(base: int, offset: Column) -> Column:
    """Coordinate on a grid of 1e-4 degrees, shifted by the line number."""
    steps = offset * 100 + (F.col("l_linenumber") - 4) * 100
    return (F.lit(base) + steps).cast("double") / F.lit(1000000.0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Orders find their customers before the lines come in, so a line is exchanged once, by its order.
    placed = orders.join(
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")
    )
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    price, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast(MONEY)
    zero = F.lit(0).cast(MONEY)

    def total_for(flag: str) -> Column:
        return F.when(F.col("l_returnflag") == flag, price).otherwise(zero)

    def mean_for(flag: str) -> Column:
        return F.when(F.col("l_returnflag") == flag, quantity)

    labelled = F.col("l_partkey") % 331 != 0
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    return joined.select(
        F.col("l_shipdate").cast("date").alias("fecha_referencia"),
        price.alias("consumo_total"),
        quantity.alias("consumo_prom"),
        total_for("A").alias("consumo_total_dom"),
        mean_for("A").alias("consumo_prom_dom"),
        total_for("N").alias("consumo_total_no_dom"),
        mean_for("N").alias("consumo_prom_no_dom"),
        total_for("R").alias("consumo_total_mixto"),
        mean_for("R").alias("consumo_prom_mixto"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("indice_des"),
        F.when(labelled, F.col("c_name")).alias("colonia"),
        F.when(labelled, F.col("n_name")).alias("alcaldia"),
        _grid(19040000, (nation * 1117) % 5000 + (key * 7919) % 600).alias("latitud"),
        _grid(-99360000, (nation * 2311) % 3600 + (key * key * 13 + key * 31) % 600).alias("longitud"),
    )


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast(MONEY)
    return orders.select(
        F.col("o_orderdate").alias("fecha_hora"),
        (amount.cast("double") / F.lit(15000.0)).alias("temperatura"),
        (F.col("o_custkey") % 101).cast("int").alias("humedad_relativa"),
        F.when(F.col("o_orderstatus") == "P", amount).otherwise(F.lit(0).cast(MONEY)).alias("lluvia"),
    )
