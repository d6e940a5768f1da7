from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubegraph.operators import dims, facts, marts, ordering, quality, rollup
from cubegraph.operators.facts import MEASURES
from cubegraph.plans.warehouse import build_star

DAY = dt.date(2019, 2, 28)
READING = (
    "fecha_referencia date, alcaldia string, colonia string, indice_des string, latitud decimal(18,6), "
    "longitud decimal(18,6), " + ", ".join(f"{m} decimal(18,6)" for m in MEASURES)
)


def reading(day=DAY, borough="A", name="x", level="ALTO", lat=19.4, lon=-99.1, total=10, mean=2, **extra):
    values = {m: None for m in MEASURES} | {"consumo_total": total, "consumo_prom": mean} | extra
    place = [None if v is None else Decimal(str(v)) for v in (lat, lon)]
    return (day, borough, name, level, *place, *[None if v is None else Decimal(str(v)) for v in values.values()])


def climate(spark, days=(DAY,), hours=((20, 50, 1), (30, 70, 2))):
    rows = [(dt.datetime.combine(d, dt.time(i)), float(t), h, Decimal(r)) for d in days for i, (t, h, r) in enumerate(hours)]
    return spark.createDataFrame(rows, "fecha_hora timestamp_ntz, temperatura double, humedad_relativa int, lluvia decimal(18,2)")


@pytest.fixture(scope="module")
def small(spark):
    readings = [
        reading(),
        reading(total=30, mean=4, lat=19.5),
        reading(borough="B", level="BAJO", total=5, lat=25.0),  # outside the box
        reading(borough="B", name="y", total=7, consumo_total_no_dom=7),
        reading(name=None),
        reading(borough=None),
        reading(level=None),
        reading(day=dt.date(2019, 3, 1)),
        reading(level=None, day=dt.date(2019, 3, 1)),  # fails two criteria
    ]
    return build_star(spark.createDataFrame(readings, READING), climate(spark))


def test_dimensions(small, rows):
    assert rows(small.dim_time) == [(1, DAY, 2019, 2, 28, 1)]
    assert [(r.id_indice_des, r.indice_des) for r in small.dim_level.orderBy("id_indice_des").collect()] == [(1, "ALTO"), (2, "BAJO")]
    units = {(r.alcaldia, r.colonia): (r.latitud, r.longitud) for r in small.dim_location.collect()}
    # Five readings carry the name, loaded or not.
    assert units[("A", "x")] == (Decimal("19.420000"), Decimal("-99.100000"))
    assert units[("B", "x")] == (None, None)
    assert (None, "x") in units  # a unit needs a name, not a borough
    assert small.dim_location.count() == 4


def test_inner_joins_drop_what_has_no_dimension_row(small):
    assert small.fact.count() == 4
    assert quality.orphans(small.fact, small.dim_location, "id_ubicacion").count() == 0


def test_loss_audit_attributes_each_row_once(small):
    got = {r.criterion: (r.records, r.pct) for r in quality.load_audit(small.readings, small.dim_time).collect()}
    assert got[quality.NO_LABEL] == (2, 22.22)
    assert got[quality.NO_LEVEL] == (2, 22.22)
    assert got[quality.NO_DAY] == (1, 11.11)
    assert got[quality.LOADED] == (4, 44.44)
    assert got[quality.DISCARDED][0] == 5 and got[quality.SOURCE][0] == 9
    assert got[quality.LOADED][0] + got[quality.DISCARDED][0] == got[quality.SOURCE][0]


def test_cleaning_audit_coerces_text(spark):
    rows = [
        ("5", "19.4", "-99.1", "A", "x", "2019-01-01"),
        ("bad", "0", "0", None, None, "?"),
        ("5", "91", "-99.1", "A", "x", "2019-01-01"),
        ("5", "19.4", "-99.1", "A", None, "2019-01-01"),
        ("5", "19.4", "-99.1", "A", "x", "never"),
    ]
    raw = spark.createDataFrame(rows, "consumo_total string, latitud string, longitud string, alcaldia string, colonia string, fecha_referencia string")
    got = {r.criterion: r.records for r in quality.cleaning_audit(raw).collect()}
    assert [got[c] for c in (quality.NO_MEASURE, quality.NO_COORDINATE, quality.NO_LABEL, quality.NO_DATE, quality.LOADED)] == [1] * 5


def test_audit_shows_criteria_nobody_meets(spark):
    got = quality.loss_audit(spark.range(3), [("never", F.lit(False))]).collect()
    assert {(r.criterion, r.records) for r in got} >= {("never", 0), (quality.LOADED, 3)}


def test_bimester_temperature_is_a_mean_of_daily_means(spark):
    days = climate(spark, [DAY], [(10, 1, 0)] * 3 + [(30, 1, 0)])
    other = climate(spark, [dt.date(2019, 1, 5)], [(31, 1, 0)])
    dim = dims.build_dim_time(days.unionByName(other))
    fact = facts.build_fact_climate(days.unionByName(other), dim)
    row = marts.climate_by_bimester(fact, dim).first()
    assert row.temp_promedio == 23.0  # mean of 15 and 31, not of five readings
    assert (row.dias_ola_calor, row.dias_frio) == (2, 1)


def test_correlation_needs_both_sides(small):
    rows = marts.correlation(small.fact, small.fact_climate, small.dim_time).collect()
    assert [(r.anio, r.bimestre, float(r.total_agua), r.temp_promedio) for r in rows] == [(2019, 1, 52.0, 25.0)]


def test_share_is_null_where_the_total_is_zero(spark, small):
    zero = small.fact.withColumn("consumo_total", F.lit(0).cast("decimal(18,6)"))
    units = rollup.added(rollup.reduced(zero), rollup.UNITS)
    assert {r.pct_no_dom for r in marts.by_borough(units, small.dim_location).collect()} == {None}


def states(*kept):
    return [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in kept]


def test_rollups_of_batches_equal_those_of_all_facts(spark, small):
    """Also after a batch is loaded again, corrected or as it was."""
    whole, parts = rollup.RollupState(spark), rollup.RollupState(spark)
    whole.merge(small.fact, small.dim_time, "all")
    first = F.col("id_fact") % 2 == 0
    parts.merge(small.fact.limit(1), small.dim_time, "01")
    for name, rows in (("01", small.fact.filter(first)), ("1", small.fact.filter(~first)), ("1", small.fact.filter(~first))):
        parts.merge(rows, small.dim_time, name)
    assert states(parts.days(), parts.periods()) == states(whole.days(), whole.periods())
    by = lambda state: marts.by_borough(state.units(), small.dim_location).collect()
    assert by(parts) == by(whole) and len(by(whole)) > 0
    assert [float(r.total) for r in marts.top_neighbourhoods(parts.units(), small.dim_location, 1).collect()] == [40.0]
    periods = marts.by_neighbourhood_bimester(parts.periods(), small.dim_location).collect()
    assert sum(float(r.total) for r in periods) == 52.0


def test_dimensions_come_from_one_pass(spark, small):
    state = dims.members(small.readings)
    assert states(dims.centroids_of(state)) == states(dims.centroids(small.readings))
    again = dims.members(small.readings.filter("latitud > 19.4")).unionByName(dims.members(small.readings.filter("latitud <= 19.4 OR latitud IS NULL")))
    assert states(dims.centroids_of(again)) == states(dims.centroids(small.readings))


def test_mart_keeps_missing_means_null(small):
    mart = marts.build_mart(small.fact, small.dim_time, small.dim_location, small.dim_level)
    rows = {(r.alcaldia, r.colonia): r for r in mart.collect()}
    assert rows[("A", "x")].consumo_prom == 3.0 and rows[("A", "x")].consumo_prom_dom is None
    assert len(rows) == 3


def test_paged_retrieval_equals_sorting_everything(small):
    rows = marts.retrieval_rows(small.fact, small.dim_time, small.dim_location, small.dim_level)
    everything = rows.orderBy(*marts.retrieval_order()).collect()
    ordered = ordering.store_ordered(rows, marts.retrieval_order(), "pages")
    assert len(everything) == 4 == ordered.total().first()["total"]
    assert [ordered.page(1, i).first() for i in range(4)] == everything
    assert ordered.page(5, 9).count() == 0 and ordered.page(100).collect() == everything


def test_a_page_reads_only_its_files(spark):
    rows = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = ordering.store_ordered(rows, ["k", "id"], "pages")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered.files.count() > 3
    everything = [r.id for r in rows.orderBy("k", "id").collect()]
    for offset in (0, 33_333, 99_950):
        page = ordered.page(100, offset)
        assert len(page.inputFiles()) <= 2
        assert [r.id for r in page.collect()] == everything[offset : offset + 100]


def test_guards(spark, small):
    empty = small.dim_location.limit(0)
    with pytest.raises(quality.QualityError, match="no unit"):
        quality.require_non_empty(empty, "no unit")
    assert quality.require_coordinates(small.dim_location) == {"units": 4, "located": 2}
    with pytest.raises(quality.QualityError):
        quality.require_coordinates(small.dim_location.withColumn("latitud", F.lit(None)))
    with pytest.raises(quality.QualityError, match="expected 5"):
        quality.require_cardinality(small.dim_location, 5)
    with pytest.raises(quality.QualityError):
        build_star(spark.createDataFrame([reading(name=None)], READING), climate(spark))


def test_centroid_rounds_half_away_from_zero(spark):
    rows = [reading(lat=19.4, lon=-99.1)] * 7 + [reading(lat=19.4001, lon=-99.1001)]
    point = dims.centroids(spark.createDataFrame(rows, READING)).first()
    assert (point.latitud, point.longitud) == (Decimal("19.400013"), Decimal("-99.100013"))


def test_reports(small):
    counted = {r.tabla: r.n for r in quality.cardinalities({"fact": small.fact, "time": small.dim_time}).collect()}
    assert counted == {"fact": 4, "time": 1}
    span = quality.date_range(small.readings, "fecha_referencia").first()
    assert (span.desde, span.hasta, span.dias) == (DAY, dt.date(2019, 3, 1), 2)
    assert quality.duplicates(small.dim_location, "colonia").first().n == 3


def test_climate_means_do_not_depend_on_the_order(spark):
    for hours in ([(0.1, 1, 0), (0.2, 2, 0), (0.3, 4, 0)], [(0.3, 4, 0), (0.2, 2, 0), (0.1, 1, 0)]):
        row = facts.daily_rollup(climate(spark, hours=hours).coalesce(1)).first()
        assert (row["temp_promedio"], row["humedad_promedio"]) == (0.6 / 3, 7 / 3)


def test_climate_means_without_a_decimal(spark):
    row = facts.daily_rollup(climate(spark, hours=[(1e300, 1, 0), (3e300, 1, 0)])).first()
    assert row["temp_promedio"] == 2e300
    none = climate(spark, hours=[(1, 1, 0)]).withColumn("temperatura", F.lit(None).cast("double"))
    assert facts.daily_rollup(none).first()["temp_promedio"] is None


def test_lines_are_exchanged_once_by_their_order(spark, tmp_path):
    """Orders find their customers first; the last join is that of the lines, whose exchange also evens the stored files."""
    from cubegraph.sources import reaimed

    tables = {
        "lineitem": ([(1, 1, 1, 1, 2.0, 3.0, "A", dt.datetime(1997, 1, 1))] * 2 + [(9, 1, 1, 1, 2.0, 3.0, "A", dt.datetime(1997, 1, 1))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"),
        "orders": ([(1, 5, "F", "5-LOW", 1.0, dt.datetime(1997, 1, 1)), (1, 6, "F", None, 1.0, dt.datetime(1997, 1, 1)), (None, 5, "F", "5-LOW", 1.0, dt.datetime(1997, 1, 1))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp"),
        "customer": ([(5, "a", 0), (5, "b", 0), (6, "c", None)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(0, "n")], "n_nationkey int, n_name string"),
    }
    for name, (rows_, schema) in tables.items():
        spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = reaimed.readings(spark, str(tmp_path))
        joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
        assert len(joins) == 3 and "l_orderkey" in joins[0]
        assert sorted((r.colonia, float(r.consumo_total)) for r in got.collect()) == [("a", 3.0), ("a", 3.0), ("b", 3.0), ("b", 3.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
