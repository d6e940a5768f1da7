from __future__ import annotations

import json

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubegraph.functions.text import contains_folded
from cubegraph.operators import marts, names, quality, retrieval
from cubegraph.sources import readers, writers
from cubegraph.sources.schemas import CORRELATION_ROW, MART_ROW

SCHEMA = (
    "anio int, bimestre int, fecha date, alcaldia string, colonia string, latitud decimal(9,6), longitud decimal(9,6), "
    "indice_des string, consumo_total decimal(18,2), consumo_prom double, consumo_total_dom decimal(18,2), consumo_prom_dom double, "
    "consumo_total_mixto decimal(18,2), consumo_prom_mixto double, consumo_total_no_dom decimal(18,2), consumo_prom_no_dom double"
)


def row(year=2019, bimester=1, borough="A", name="x", level="ALTO", total=10, mean=2.0, lat="19.400001"):
    number = None if total is None else Decimal(total)
    place = None if lat is None else Decimal(lat)
    return (year, bimester, dt.date(year, 2, 1), borough, name, place, place, level, number, mean, number, None, None, None, number, mean)


@pytest.fixture
def mart(spark):
    data = [
        row(), row(name="y", total=20, mean=None), row(borough="B", total=40, mean=4.0),
        row(borough="B", name=None, total=None), row(2020, 2, "B", "", "BAJO", 1), row(2020, 2, "", "z", "BAJO", 5),
        row(2020, 2, None, "z", "BAJO", 6),
    ]
    return spark.createDataFrame(data, SCHEMA)


CORR = [(2019, 1, 100.0, 20.5, 1, 0, 3.14159), (2020, 2, 200.0, 21.0, None, 2, None)]
CORR_SCHEMA = "anio int, bimestre int, total_agua double, temp_promedio double, dias_ola_calor long, dias_frio long, total_lluvia double"


def test_empty_parameters_constrain_nothing(mart):
    assert retrieval.retrieve(mart).count() == 7
    assert retrieval.retrieve(mart, alcaldia="", colonia=None).count() == 7
    assert retrieval.retrieve(mart, anio=2019, bimestre=1, alcaldia="B", colonia="x", indice="ALTO").count() == 1


def test_indicator_means_count_nulls_as_zero(mart):
    shown = retrieval.kpis(retrieval.retrieve(mart, anio=2019)).first()
    assert (shown.registros, shown.total, shown.promedio) == (4, 70.0, 2.0)
    assert retrieval.kpis(mart).first().colonias == 3  # x, y, z: borough and empty names ignored
    empty = retrieval.kpis(mart.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0)


def test_profiles_count_null_as_a_member(mart):
    got = {r.alcaldia: r for r in retrieval.borough_profile_all(mart).collect()}
    assert got["B"].num_colonias == 3 and got["B"].num_registros == 3
    assert got["B"].consumo_total == 41.0 and got["B"].consumo_prom == pytest.approx((4 + 2 + 2) / 3)
    totals = [r.consumo_total for r in retrieval.borough_profile_all(mart).collect()]
    assert totals == sorted(totals, reverse=True)


def test_single_profile_by_folded_name_and_default_row(mart):
    found = retrieval.borough_profile(mart, " b ").first()
    assert (found.alcaldia, found.num_colonias, found.anio_min, found.anio_max, found.sin_datos) == (" b ", 3, 2019, 2020, False)
    missing = retrieval.borough_profile(mart, "nowhere").first()
    assert (missing.num_registros, missing.consumo_prom, missing.anio_min, missing.sin_datos) == (0, 0.0, None, True)


def test_borough_totals_skip_unnamed_ones(mart):
    assert [(r.alcaldia, r.total) for r in retrieval.totals_by_borough(mart).collect()] == [("B", 41.0), ("A", 30.0)]
    merged = {(r.colonia, r.alcaldia) for r in retrieval.totals_by_neighbourhood(mart).collect()}
    assert ("x", "A") in merged and ("x", "B") in merged


def test_correlation_falls_back_to_the_stored_total(spark, mart):
    corr = spark.createDataFrame(CORR, CORR_SCHEMA)
    panel = retrieval.correlation_panel(corr, retrieval.retrieve(mart, alcaldia="A"))
    assert {(r.anio, r.total_agua) for r in panel.collect()} == {(2019, 30.0), (2020, 200.0)}


def test_names_reconcile_exactly_then_folded(spark):
    data = spark.createDataFrame([("CUAUHTEMOC", 9.0), ("Tlalpan", 5.0), ("TLALPAN", 3.0), (None, 1.0)], "alcaldia string, consumo_total double")
    polygons = spark.createDataFrame([("Cuauhtémoc",), ("TLALPAN",), (" tlalpan",), ("Unknown",)], "nombre string")
    got = {r.nombre: r.consumo_total for r in retrieval.reconcile(polygons, data).collect()}
    assert got == {"Cuauhtémoc": 9.0, "TLALPAN": 3.0, " tlalpan": 3.0, "Unknown": None}


def test_search_needs_three_characters(spark):
    dim = spark.createDataFrame([(1, "A", "Álamos"), (2, "B", "LOS ALAMOS"), (3, "A", "Roma")], "id_ubicacion long, alcaldia string, colonia string")
    assert retrieval.search(dim, "al").count() == 0
    assert [r.id_ubicacion for r in retrieval.search(dim, "alamo").collect()] == [1, 2]
    assert [r.id_ubicacion for r in retrieval.search(dim, "ÁLAMO", alcaldia="b").collect()] == [2]
    assert retrieval.search(dim, "alamo", limit=1).count() == 1


def test_initial_selection_falls_back_in_order(spark):
    dim = spark.createDataFrame([(1, "A", "ZETA"), (2, "A", "ROMA SUR"), (3, "B", "ALFA")], "id_ubicacion long, alcaldia string, colonia string")
    pick = lambda **kw: retrieval.initial_selection(dim, **kw).first().id_ubicacion
    assert pick() == 2 and pick(colonia="alfa") == 3 and pick(colonia="?", alcaldia="b") == 3
    assert pick(alcaldia="a", pattern="NADA") == 2
    assert retrieval.initial_selection(dim, alcaldia="nowhere").count() == 0


def test_highlight_is_by_name(spark):
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "z")], "id_ubicacion long, colonia string")
    result = spark.createDataFrame([("y",), ("x",)], "vecina string")
    assert sorted(r.id_ubicacion for r in retrieval.named_neighbours(dim, result, 1).collect()) == [2, 3]


def test_catalogue_lists_members_under_their_borough(mart):
    got = {(r.kind, r.parent, r.value) for r in retrieval.catalogue(mart).collect()}
    assert ("colonia", "A", "x") in got and ("colonia", "B", "x") in got and ("anio", None, "2020") in got


def test_export_validates_before_it_writes(spark, mart, tmp_path):
    corr = spark.createDataFrame(CORR, CORR_SCHEMA)
    target = str(tmp_path / "out")
    problems = writers.export_mart(mart, corr.limit(0), target)
    assert {p.split(":")[0] for p in problems} == {"too few boroughs", "correlation is empty", "first rows without a total"}
    assert not (tmp_path / "out").exists()
    assert writers.export_mart(mart.drop("fecha"), corr, target) == ["missing column fecha"]
    good = mart.filter("consumo_total IS NOT NULL")
    assert writers.export_mart(good, corr, target, min_boroughs=2, dry_run=True) == []
    assert not (tmp_path / "out").exists()
    assert writers.export_mart(good, corr, target, min_boroughs=2) == []
    back = readers.read_mart_rows(spark, target + "/consumo_colonia", MART_ROW)
    assert back.count() == 6 and back.filter("fecha = '2019-02-01'").count() == 3
    assert readers.read_mart_rows(spark, target + "/correlacion", CORRELATION_ROW).filter("dias_ola_calor = 0").count() == 1


def test_a_compressed_export_reads_back_the_same(spark, mart, tmp_path, rows, monkeypatch):
    """Files are compressed and of bounded length, so many tasks read them; the query exports so."""
    monkeypatch.setattr(writers, "FILE_ROWS", 2)
    corr, good = spark.createDataFrame(CORR, CORR_SCHEMA), mart.filter("consumo_total IS NOT NULL")
    for name in ("none", "gzip"):
        assert writers.export_mart(good, corr, str(tmp_path / name), min_boroughs=2, compression=name) == []
    plain, packed = (readers.read_mart_rows(spark, str(tmp_path / name / "consumo_colonia"), MART_ROW) for name in ("none", "gzip"))
    assert rows(plain) == rows(packed) and plain.count() == 6
    files = [p.name for p in (tmp_path / "gzip" / "consumo_colonia").glob("part-*")]
    assert len(files) >= 3 and all(f.endswith(".json.gz") for f in files)


def test_rows_without_coordinate_forbid_the_export(spark, mart):
    corr = spark.createDataFrame(CORR, CORR_SCHEMA)
    unplaced = mart.withColumn("latitud", F.when(F.col("colonia") == "z", F.col("latitud")))
    got = {r.problem: r.n for r in quality.validate_export(unplaced, corr, marts.mart_order(), 1).collect()}
    assert got["rows without a coordinate"] == 5


def test_nested_documents_are_read(spark, tmp_path):
    row = dict.fromkeys(MART_ROW.names) | {"anio": 2019, "bimestre": 1, "colonia": "x"}
    whole = {"anios": [2019, 2020], "colonias_por_alcaldia": {"A": ["x", "y"]}, "consumo_colonia": [row, row | {"colonia": "y"}], "correlacion": [{"anio": 2019, "total_lluvia": 3.14}, {"anio": 2020}]}
    (tmp_path / "doc.json").write_text(json.dumps(whole, indent=1))
    path = str(tmp_path / "doc.json")
    first = readers.read_mart_document(spark, path).first()
    assert first.anios == [2019, 2020] and first.colonias_por_alcaldia["A"] == ["x", "y"]
    assert [r.colonia for r in readers.read_mart_json(spark, path).collect()] == ["x", "y"]
    corr_back = readers.read_mart_json(spark, path, "correlacion").orderBy("anio").collect()
    assert corr_back[0].total_lluvia == 3.14 and corr_back[1].total_lluvia is None


def test_coordinates_keep_six_places_unless_rounded(mart):
    assert writers.mart_rows(mart).first().latitud == 19.400001
    assert writers.mart_rows(mart, round_coordinates=True).first().latitud == 19.4


def test_correlation_of_a_chosen_year(spark, mart):
    corr = spark.createDataFrame(CORR, CORR_SCHEMA)
    panel = retrieval.correlation_panel(corr, retrieval.retrieve(mart, alcaldia="A", anio=2019), anio=2019)
    assert {(r.anio, r.total_agua) for r in panel.collect()} == {(2019, 30.0)}


def test_name_index_finds_what_a_scan_finds(spark):
    """Accents, case, padding, short names and texts, repeated grams and letters beyond the basic plane."""
    listed = ["CENTRO", "Ampliación San Ángel", " san angel ", "SAN", "SA", "", None, "aaaa", "aaab", "banana", "ROMA 🙂🙂🙂", "R.O.M.A"]
    dim = spark.createDataFrame(list(enumerate(listed)), "id_ubicacion int, colonia string")
    index = names.index_names(dim, "id_ubicacion", "colonia")
    for text in ("san", "ÁNGEL", " san angel", "aaa", "anana", "🙂🙂🙂", "a", "sa", "zzz", "n ang", "o.m"):
        expect = dim.filter(contains_folded(F.col("colonia"), text))
        assert sorted(r.id_ubicacion for r in index.search(text).collect()) == sorted(r.id_ubicacion for r in expect.collect())
    plan = index.search("angel")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
