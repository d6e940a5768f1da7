from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubegraph.sources import readers, schemas, writers

HEADER = ",".join(schemas.CONSUMPTION.names)


def line(level="ALTO", name="x", total="5.25"):
    return f"2019-02-28,2019,1,NA,NA,NA,NA,{total},1,NA,NA,{level},{name},A,19.4,-99.1"


def test_only_the_token_becomes_null(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("\n".join([HEADER, line(), line("NA", '""'), line(name=" "), line(name='"a, b"')]) + "\n")
    got = readers.read_csv(spark, str(path), schemas.CONSUMPTION).collect()
    assert got[0].fecha_referencia == dt.date(2019, 2, 28) and got[0].consumo_total == Decimal("5.25")
    assert got[0].consumo_prom_dom is None and got[0].latitud == Decimal("19.4")
    assert (got[1].indice_des, got[1].colonia) == (None, "")
    assert got[2].colonia == " " and got[3].colonia == "a, b"


def test_a_malformed_number_fails_the_load(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("\n".join([HEADER, line(total="five")]) + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_csv(spark, str(path), schemas.CONSUMPTION).collect()


@pytest.mark.parametrize(
    "field, value",
    [('"EL ""ROSAL"""', 'EL "ROSAL"'), ('"A "", B"', 'A ", B'), ('"ends \\"', "ends \\"), ('"two\nlines"', "two\nlines"), ("plain \\ slash", "plain \\ slash")],
)
def test_quoted_fields(spark, tmp_path, field, value):
    path = tmp_path / "q.csv"
    path.write_text("\n".join([HEADER, line(name=field), line(name="next")]) + "\n")
    got = readers.read_csv(spark, str(path), schemas.CONSUMPTION, multiline=True).collect()
    assert [(r.colonia, r.alcaldia, float(r.latitud)) for r in got] == [(value, "A", 19.4), ("next", "A", 19.4)]


@pytest.mark.parametrize("size", ["1g", "300"])
def test_records_of_a_split_file(spark, tmp_path, size):
    """Line breaks, doubled quotes, carriage returns and empty lines in fields that splits cut anywhere, against the whole-file reader."""
    r = random.Random(3)
    texts = ["plain", "two\nlines", 'say ""hi""', "a\n\n\nb", '""', "x, y\n, z", "\n", "é\n""", "long " * 60 + "\n" + "end " * 80]
    names = [r.choice(texts) for _ in range(300)]
    for k in range(2):
        rows = [line(name=f'"{n}"', total=str(k)) for n in names]
        (tmp_path / f"{k}.csv").write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "300" else "4m")
    try:
        got = readers.read_csv_records(spark, str(tmp_path), schemas.CONSUMPTION)
        found = sorted((tuple(x) for x in got.collect()), key=repr)
        tasks = readers.csv_records(spark, str(tmp_path)).select("file", "split").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = readers.read_csv(spark, str(tmp_path), schemas.CONSUMPTION, multiline=True)
    assert len(found) == 600 and found == sorted((tuple(x) for x in whole.collect()), key=repr)
    assert tasks > 50 if size == "300" else tasks == 2


@pytest.mark.parametrize("ragged", [line().rsplit(",", 2)[0], line() + ",surplus"])
def test_ragged_rows_fail_the_load(spark, tmp_path, ragged):
    path = tmp_path / "r.csv"
    path.write_text("\n".join([HEADER, line(), ragged]) + "\n")
    rows = readers.read_csv(spark, str(path), schemas.CONSUMPTION)
    for asked in (rows.collect, rows.count, rows.select("consumo_total").collect, rows.select("latitud").distinct().collect):
        with pytest.raises(Exception, match="MALFORMED"):
            asked()


def test_a_named_batch_is_loaded_once(spark, tmp_path):
    """Again, corrected, after a failure, and beside others; names of batches are texts."""
    path = str(tmp_path / "f")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    writers.load_fact(rows(1, 2, 3), path, "id", "01")
    writers.load_fact(rows(10), path, "id", "1")
    broken = rows(4, 5).withColumn("v", F.when(F.col("v") == 5, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        writers.load_fact(broken, path, "id", "2")
    got = writers.load_fact(rows(1, 2, 4), path, "id", "01")
    assert sorted((r.batch, r.v) for r in got.collect()) == [("01", 1), ("01", 2), ("01", 4), ("1", 10)]
    assert got.select("id").distinct().count() == 4


def test_written_text_is_read_back(spark, tmp_path):
    path = str(tmp_path / "w")
    texts = ['a "b", c', "two\nlines", "end\\", ""]
    writers.write_csv(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1), path)
    back = readers.read_csv_coerced(spark, path, {"i": "int"}, multiline=True).orderBy("i").collect()
    assert [r.t or "" for r in back] == texts


def test_climate_columns_go_by_position(spark, tmp_path):
    path = tmp_path / "w.csv"
    header = ",".join(schemas.CLIMATE_HEADERS.values())
    path.write_text(f"{header}\n2019-01-01T05:00,12.5,60,NA\n", encoding="utf-8")
    row = readers.read_csv(spark, str(path), schemas.CLIMATE).first()
    assert tuple(row) == (dt.datetime(2019, 1, 1, 5), Decimal("12.5"), 60, None)


def test_text_reader_nulls_padded_tokens_and_replaces_bad_bytes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("time,rain (mm),x\na, NA ,\nb,1,caf\xe9\n".encode("latin-1"))
    got = readers.read_csv_text(spark, str(path)).collect()
    assert got[0]["rain (mm)"] is None and got[0].x is None
    assert got[1].x == "caf�"


def test_coerced_reader_nulls_what_does_not_parse(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1.5,x\nbad,y\n")
    got = readers.read_csv_coerced(spark, str(path), {"a": "double"}).collect()
    assert [(r.a, r.b) for r in got] == [(1.5, "x"), (None, "y")]


def test_polygons_keep_geometry_and_first_name(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[-99.1, 19.4], [-99.2, 19.4], [-99.1, 19.5]]]}
    features = [
        {"type": "Feature", "properties": {"NOMGEO": "", "nomgeo": "Tláhuac", "id": 3}, "geometry": shape},
        {"type": "Feature", "properties": {"name": "Tlalpan"}, "geometry": shape},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False), encoding="utf-8")
    got = readers.read_geojson(spark, str(path)).collect()
    assert [r.nombre for r in got] == ["Tláhuac", "Tlalpan", ""]
    assert json.loads(got[0].geometry) == shape and got[2].geometry is None


def test_curves_are_written_with_a_header(spark, tmp_path):
    path = str(tmp_path / "curves")
    writers.write_csv(spark.createDataFrame([(1, 0.5)], "point int, precision double"), path)
    assert spark.read.option("header", True).csv(path).columns == ["point", "precision"]


def test_tables_are_appended_with_keys(spark, tmp_path, rows):
    dim = writers.load_dim(spark.createDataFrame([("b",), ("a",)], "v string"), str(tmp_path / "d"), ["v"], "id")
    assert rows(dim) == [(1, "a"), (2, "b")]
    again = spark.createDataFrame([("c",), ("a",), ("c",), (None,)], "v string")
    assert rows(writers.load_dim(again, str(tmp_path / "d"), ["v"], "id")) == [(1, "a"), (2, "b"), (3, None), (4, "c")]
    assert writers.load_dim(again, str(tmp_path / "d"), ["v"], "id").count() == 4
    for batch in (1, 2):
        fact = writers.load_fact(spark.range(5), str(tmp_path / "f"), "id_fact")
        assert fact.select("id_fact").distinct().count() == fact.count() == 5 * batch


def test_staging_is_dropped_if_it_exists(spark):
    spark.range(1).createOrReplaceTempView("stg_once")
    writers.drop_staging(spark, ["stg_once", "never_there"])
    assert not spark.catalog.tableExists("stg_once")


def test_database_reader_partitions_when_bounded(spark):
    # No database here: only the options up to the driver lookup are exercised.
    with pytest.raises(Exception, match="driver|JDBC|jdbc"):
        readers.read_jdbc(spark, "jdbc:none://x", "SELECT 1", partition_column="id", bounds=(0, 9), partitions=3)
