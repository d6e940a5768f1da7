from __future__ import annotations

import random

import datetime as dt
import math
import unicodedata
from decimal import Decimal
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubegraph.functions import dates, geo, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def each(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_bimester(spark):
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = months.select("m", dates.bimester(F.col("m")).alias("b")).orderBy("m").collect()
    assert [r.b for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]


def test_dates(spark):
    assert each(spark, ["2019-03-01T05:00", "2019-03-01"], dates.iso_day) == ["2019-03-01"] * 2
    assert each(spark, ["2019-02-28", "2019-02-30", "x", None], dates.try_date) == [
        dt.date(2019, 2, 28), None, None, None,
    ]
    assert one(spark, dates.iso_date(F.lit(dt.date(2019, 2, 3)))) == "2019-02-03"
    stamp = F.lit("2019-02-03 04:05:06").cast("timestamp")
    assert one(spark, dates.utc_stamp(stamp)) == "2019-02-03T04:05:06Z"
    day = F.lit(dt.date(2019, 12, 31))
    assert one(spark, F.struct(dates.year_of(day), dates.month_of(day), dates.day_no(day))) == (2019, 12, 31)


def test_percentages_guard_a_zero_whole(spark):
    assert one(spark, numbers.pct(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, numbers.pct(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.pct(F.lit(1), F.lit(0), on_zero=0)) == 0.0


def test_choropleth_classes_include_their_lower_bounds(spark):
    values = [None, float("nan"), 0.0, 0.19, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert each(spark, values, numbers.choropleth_class, "double") == [0, 0, 1, 1, 2, 3, 4, 5, 5]


def test_number_texts(spark):
    assert each(spark, [1234567.891, 5.0, 0.5, None], numbers.number_text, "double") == [
        "1,234,567.89", "5", "0.5", "—",
    ]
    assert each(spark, [2.0, None, 1.125, 1.375], numbers.fixed2, "double") == ["2.00", "0.00", "1.12", "1.38"]
    assert each(spark, ["1.5", "x", None], numbers.try_number) == [1.5, None, None]
    assert each(spark, ["ALTO", "POPULAR", "?"], numbers.ordinal_rank) == [4, 1, None]


def test_two_decimals_are_those_of_the_exact_double(spark):
    values = [2.675, 1.115, 8.345, 0.125, 0.375, 0.005, 1e-9, 0.0, -2.675, -0.125, 1234567.895, 1e13 + 0.125, 99.995, 0.995, 4.35, 1e17]
    r = random.Random(1)
    values += [r.randint(0, 10**7) / 1000 for _ in range(2000)] + [r.random() * 10 ** r.randint(-3, 12) for _ in range(2000)]
    assert each(spark, values, numbers.fixed2, "double") == ["%.2f" % v for v in values]


def test_same_name_ignores_accents_case_and_padding(spark):
    df = spark.createDataFrame(
        [("Cuauhtémoc", "CUAUHTEMOC"), (" tláhuac\t", "TLAHUAC"), ("ñ", "N"), (None, ""), ("Roma", "Romo")],
        "a string, b string",
    )
    got = [r.v for r in df.select(text.same_name(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [True, True, True, True, False]


def fold_reference(value: str) -> str:
    spaces = text._SPACES
    parts = unicodedata.normalize("NFD", value.strip(spaces).lower())
    return "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)


LATIN = st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(LATIN, min_size=40, max_size=60))
def test_fold_equals_decomposition(spark, values):
    # Characters whose decomposition keeps several letters do not occur below U+0250.
    assert each(spark, values, text.fold) == [fold_reference(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), max_size=10), min_size=40, max_size=60))
def test_iri_segment_equals_percent_encoding(spark, values):
    assert each(spark, values, text.iri_segment) == [quote(v, safe="") for v in values]


def test_iri_fixture_and_uri_component(spark):
    values = ["GUSTAVO A. MADERO", "*", "~", "/", "É", "a'(b)!"]
    assert each(spark, values, text.iri_segment) == [
        "GUSTAVO%20A.%20MADERO", "%2A", "~", "%2F", "%C3%89", "a%27%28b%29%21",
    ]
    assert each(spark, values, text.uri_component)[-1] == "a'(b)!"
    assert each(spark, ["*"], text.uri_component) == ["*"]


def test_last_segment(spark):
    assert each(spark, ["http://a/b", "http://a#c", "plain", "http://a/"], text.last_segment) == [
        "b", "c", "plain", "http://a/",
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='ab"\\\n\r\tnu0é', max_size=12), min_size=40, max_size=60))
def test_literal_escaping_round_trips(spark, values):
    back = each(spark, values, lambda c: text.unescape_literal(text.escape_literal(c)))
    assert back == values


def test_unicode_escapes_are_read(spark):
    assert each(spark, ["caf\\u00E9 \\u0041", "\\\\u0041"], text.unescape_literal) == ["café A", "\\u0041"]


def test_clean_label(spark):
    values = ["📍  Cuauhtémoc — (centro)", "a_b c", None, " x.-y "]
    assert each(spark, values, text.clean_label) == ["CUAUHTÉMOC (CENTRO)", "A B C", "", "X.-Y"]


def test_membership_by_cleaned_name(spark):
    names = ["CUAUHTEMOC", "TLALPAN"]
    got = each(spark, ["📍 Cuauhtémoc", "tlalpan ", "Roma", None], lambda c: text.is_member(c, names))
    assert got == [True, True, False, False]


def test_missing_and_present(spark):
    values = ["NA", " NA ", "", " ", None, "x"]
    assert each(spark, values, text.is_missing) == [True] * 5 + [False]
    assert each(spark, ["", None, "x"], text.is_present) == [False, False, True]


def test_labels_placeholders_and_ellipsis(spark):
    assert each(spark, ["alto", "otro", "", None], lambda c: text.translate_label(c, "en")) == [
        "HIGH", "otro", "—", "—",
    ]
    labels = {"es": {"A": "a-es", "B": "b-es"}, "en": {"A": "a-en"}}
    assert each(spark, ["A", "B"], lambda c: text.translate_label(c, "en", labels)) == ["a-en", "b-es"]
    filled = text.fill_placeholders(F.lit("{a}-{b}-{zz}"), {"a": F.lit("{b}"), "b": F.lit(7)})
    assert one(spark, filled) == "{b}-7-{zz}"
    assert each(spark, ["x" * 30, "x" * 31, "x" * 28 + "  y"], text.ellipsis) == [
        "x" * 30, "x" * 29 + "…", "x" * 28 + "…",
    ]
    assert one(spark, text.first_present(F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "b"
    assert one(spark, text.first_present(F.lit(""))) == ""


def test_template_expansion(spark):
    df = spark.createDataFrame([("A B", 1), (None, 2)], "n string, i int")
    got = df.select(text.expand("http://x/{n}/{i}", {"n": F.col("n"), "i": F.col("i").cast("string")}).alias("v"))
    assert [r.v for r in got.collect()] == ["http://x/A B/1", None]


def test_wkt_keeps_trailing_zeros(spark):
    point = geo.wkt_point(F.lit(Decimal("-99.100000")), F.lit(Decimal("19.400000")))
    assert one(spark, point) == "POINT(-99.100000 19.400000)"


def test_distance_is_directed(spark):
    a, b = (19.0, -99.0), (19.5, -99.4)
    there = one(spark, geo.distance_km(*[F.lit(x) for x in (*a, *b)]))
    back = one(spark, geo.distance_km(*[F.lit(x) for x in (*b, *a)]))
    expected = 111.32 * math.hypot(0.5, 0.4 * math.cos(math.radians(19.0)))
    assert there == pytest.approx(expected) and back < there


def test_box_is_inclusive(spark):
    df = spark.createDataFrame([(19.04, -99.36), (19.6, -98.94), (19.61, -99.0)], "a double, o double")
    assert [r.v for r in df.select(geo.in_bbox(F.col("a"), F.col("o")).alias("v")).collect()] == [True, True, False]


def test_thousandths_round_as_the_text_does(spark):
    values = [0.0, 0.0005, 0.0015, 1.0005, 1.4995, 1.499500000001, 0.1234999999999, 2.675, 1.0, 1.5, 0.1, 999.9995, -0.0015, -1.2345, 123456.7885]
    values += [k / 2000 for k in range(1, 400)] + [(k / 2000) * (1 + 2**-52) for k in range(1, 400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wrong = df.filter(numbers.thousandths(F.col("x")) != F.round("x", 3).cast("decimal(12,3)"))
    assert wrong.count() == 0
