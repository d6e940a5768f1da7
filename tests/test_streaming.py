from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cubegraph.operators.facts import daily_rollup
from cubegraph.streaming.daily import daily_rollup_stream

SCHEMA = "fecha_hora timestamp, temperatura double, humedad_relativa int, lluvia decimal(18,2)"


def test_finished_days_equal_the_batch_rollup(spark, tmp_path):
    series = spark.range(0, 24 * 6).select(
        (F.lit(dt.datetime(2019, 2, 27)).cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("fecha_hora"),
        (F.col("id") % 17).cast("double").alias("temperatura"),
        (F.col("id") % 90).cast("int").alias("humedad_relativa"),
        (F.col("id") % 3).cast("decimal(18,2)").alias("lluvia"),
    )
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    series.write.parquet(source)
    days = daily_rollup_stream(spark.readStream.schema(SCHEMA).parquet(source))
    query = (
        days.writeStream.outputMode("append").format("parquet")
        .option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    expected = sorted(map(tuple, daily_rollup(series).collect()))
    assert got and got == expected[: len(got)] and len(got) >= 4
