import time
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cubegraph.operators import termstore
from cubegraph.session import end_table, materialise_buckets, materialise_table, stored_paths
from cubegraph.sources.vocabulary import TRIPLE_SCHEMA, iri


def exchanged(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).rglob("shuffle_*")}


def test_what_an_action_exchanged_ends_with_it(spark):
    before = exchanged(spark)
    table = materialise_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "ends")
    for _ in range(100):
        if not exchanged(spark) - before:
            break
        time.sleep(0.1)
    assert not exchanged(spark) - before
    assert table.count() == 7
    end_table(table)


def test_frames_can_be_read_again_after_their_exchanges_ended(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(df.collect()) == sorted(df.collect())
    assert df.count() == 7


def test_stored_tables_are_packed(spark):
    table = materialise_table(spark.range(10), "packed")
    part = next(Path(table.stored_at.removeprefix("file:")).glob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
    end_table(table)


def test_buckets_written_in_parts(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("p"), F.col("id") % 7).alias("p"), (F.col("id") % 11).alias("k"))
    whole = materialise_buckets(rows, "whole", "k", 3, partition_by="p")
    parted = materialise_buckets(rows, "parted", "k", 3, partition_by="p", parts=4)
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, whole.collect()))
    counted = parted.groupBy("p", "k").count()
    assert "Exchange" not in counted._jdf.queryExecution().toString().partition("Physical Plan")[2]
    assert counted.count() == 77


def test_texts_end_once_they_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(termstore, "PART_TRIPLES", 2)
    row = ["s1", "p1", "o1", "iri", None, None]
    texts = [row, ["s1", "p2", "5", "literal", iri("xsd:integer"), None], ["s2", "p1", "o1", "iri", None, None], ["s2", "p3", "x", "literal", None, "es"]]
    before = set(stored_paths(spark))
    graph = termstore.store_terms(spark.createDataFrame(texts, TRIPLE_SCHEMA), "ends")
    left = sorted(p.rpartition("/")[2].rpartition("-")[0] for p in stored_paths(spark) if p not in before)
    assert left == ["ends", "terms"]
    assert sorted(map(tuple, graph.frame().collect()), key=repr) == sorted(map(tuple, texts), key=repr)
