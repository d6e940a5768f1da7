from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubegraph.operators import ordering as o
from cubegraph.operators import relational as r


def test_enumeration_is_dense_and_ordered(spark):
    values = random.Random(1).sample(range(10_000), 3_000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {x.v: x.n for x in o.enumerate_rows(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), 1)}


def test_surrogate_key_follows_the_natural_key(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y")], "k string, w string")
    got = {(x.k, x.w): x.id for x in o.with_surrogate_key(df, ["k", "w"], "id").collect()}
    assert got == {("a", "y"): 1, ("a", "z"): 2, ("b", "x"): 3}


def test_serial_is_unique(spark):
    assert o.with_serial(spark.range(0, 1000, 1, 9), "id2").select("id2").distinct().count() == 1000


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, i int, x int").repartition(5)
    got = {(x.k, x.i): (x.total, x.n) for x in o.running_totals(df, ["k"], [F.desc("i")], {"total": "x", "n": F.lit(1)}).collect()}
    sums, counts, expected = defaultdict(int), defaultdict(int), {}
    for k, i, x in sorted(rows, key=lambda t: -t[1]):
        sums[k] += x
        counts[k] += 1
        expected[k, i] = (sums[k], counts[k])
    assert got == expected


def test_running_totals_without_keys(spark):
    got = o.running_totals(spark.range(100), [], ["id"], {"t": "id"}).orderBy("id").collect()
    assert [x.t for x in got] == [i * (i + 1) // 2 for i in range(100)]


def test_hash_ranks_are_dense_per_key(spark):
    df = spark.range(2_000).select(
        (F.col("id") % 2).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("h")
    )
    got = o.hash_ranks(df, ["k"], "h", "rank").collect()
    for key in (0, 1):
        mine = sorted((x.h, x["rank"]) for x in got if x.k == key)
        assert [n for _, n in mine] == list(range(1, 1_001))


def test_top_k_per_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(k, d, i) for i, (k, d) in enumerate([(1, 5), (1, 5), (1, 2), (2, 9)])], "k int, d int, i int")
    out = o.top_k_per_key(df, "k", ["d", "i"], 2)
    assert sorted((x.k, x.i) for x in out.collect()) == [(1, 0), (1, 2), (2, 3)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_deep_pages_equal_a_full_sort(spark):
    n = 1_200_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n).alias("id"))
    assert [x.id for x in o.numbered_page(df, ["id"], 4, 1_100_000).collect()] == list(range(1_100_000, 1_100_004))
    small = spark.range(0, 50, 1, 4).select((49 - F.col("id")).alias("id"))
    assert o.numbered_page(small, ["id"], 4, 20).collect() == o.page(small, ["id"], 4, 20).collect()


def test_pages(spark):
    df = spark.range(10)
    assert [x.id for x in o.page(df, ["id"], 3, 6).collect()] == [6, 7, 8]
    head, total = o.top_with_total(df, [F.desc("id")], 2)
    assert [x.id for x in head.collect()] == [9, 8] and total.first().total == 10


@pytest.mark.parametrize(
    "total, page_no, expected",
    [
        (0, 1, (1, 1, 0, 0, True, True)),
        (120, 1, (3, 1, 1, 50, True, False)),
        (120, 3, (3, 3, 101, 120, False, True)),
        (120, 99, (3, 3, 101, 120, False, True)),
        (120, -4, (3, 1, 1, 50, True, False)),
        (100, 2, (2, 2, 51, 100, False, True)),
    ],
)
def test_page_info(spark, total, page_no, expected):
    row = o.page_info(spark.createDataFrame([(total,)], "total long"), 50, page_no).first()
    assert tuple(row)[1:] == expected


def test_minmax_of_a_flat_relation_divides_by_one(spark):
    flat = o.minmax_scale(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x")
    assert {x.scaled for x in flat.collect()} == {0.0}
    spread = o.minmax_scale(spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double"), "x")
    assert sorted(x.scaled for x in spread.collect()) == [0.0, 0.5, 1.0]
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_insert_ignore_keeps_stored_rows(spark, rows):
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "k int, v string")
    assert rows(r.insert_ignore(stored, new, "k")) == [(1, "old"), (2, "new")]


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = r.ensure_columns(df, spark.createDataFrame([], "a int, b decimal(9,6)").schema)
    assert out.columns == ["a", "b"] and out.first().b is None


def test_one_to_one_join_refuses_repeated_keys(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert rows(r.join_one_to_one(a, b, ["k"])) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(Exception, match="not unique in the right"):
        r.join_one_to_one(a, b.unionByName(b), ["k"]).collect()


def test_small_verbs(spark, rows):
    df = r.values_df(spark, [(1, "a", None), (2, "b", 3), (2, "b", 4)], "k int, v string, w int")
    assert r.require_present(df, "w").count() == 2
    keys = spark.createDataFrame([(2,)], "k int")
    assert r.missing(df, keys, "k").count() == 1


def test_first_match_prefers_the_earlier_criterion(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    reason = r.first_match([("low", F.col("x") < 3), ("two", F.col("x") == 2)], otherwise="rest")
    assert [x.v for x in df.select(reason.alias("v")).collect()] == ["low", "low", "rest"]


def test_numeric_columns(spark):
    df = spark.createDataFrame([(i, "1.5" if i else None, "x") for i in range(40)] + [(99, "text", "x")], "i int, a string, b string")
    got = {x.column_name: x.is_numeric for x in r.numeric_columns(df, ["i"]).collect()}
    assert got == {"i": True, "a": True, "b": False}
