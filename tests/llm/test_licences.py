from pyspark.sql import functions as F

from cubegraph.llm import licences as c
from tests.llm import cases

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
ROWS = [
    (1, f"{APACHE}\n" + cases.prose(200, 1), "a/x.txt"),
    (2, cases.prose(200, 2), "a/x2.txt"),
    (3, MIT, "a/LICENSE"),
    (4, APACHE, "a/b/COPYING.md"),
    (5, cases.prose(50, 3), "a/b/c/d/y"),
    (6, cases.prose(50, 4), "a/bb/y"),
    (7, cases.prose(50, 5), "z/y"),
    (8, None, None),
    (9, "", "a/e/"),
    (None, cases.prose(5000, 6) + ". " + MIT, "q/r"),
    (10, "license version the under", "z/w"),
    (11, MIT, "a/LICENSE.second"),
    (2, cases.prose(200, 2), "a/x2.txt"),
]


def test_own_and_inherited(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, path string")
    got = sorted(((r["doc_id"], r["licence"], r["origin"], r["licence_doc"]) for r in c.licensed(df).collect()), key=repr)
    assert got == sorted(
        [
            (1, "Apache-2.0", "own", None), (2, "MIT", "directory", 3), (2, "MIT", "directory", 3), (3, "MIT", "own", None), (4, "Apache-2.0", "own", None),
            (5, "Apache-2.0", "directory", 4), (6, "MIT", "directory", 3), (7, None, None, None), (8, None, None, None), (9, "MIT", "directory", 3),
            (None, "MIT", "own", None), (10, None, None, None), (11, "MIT", "own", None),
        ],
        key=repr,
    )


def test_heavy_terms_bound_the_cosine(spark):
    _, idf = c.rarity(spark.createDataFrame(ROWS, "doc_id long, text string, path string"))
    heavy = set(c.heavy_terms(idf))
    for k in range(len(c.TEMPLATES)):
        weights = {t: n * idf[t] for i, _, t, n in c.template_terms() if i == k}
        light = sum(w * w for t, w in weights.items() if t not in heavy)
        assert light < (c.LEAST**2) * sum(w * w for w in weights.values())


def test_planted_lines_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = c.licensed(c.with_paths(docs)).filter("origin = 'own'").select("doc_id").distinct()
    planted = docs.filter(F.col("text").rlike(r"(?i)(licensed under|under the MIT)")).select("doc_id")
    assert planted.count() > 0 and planted.join(got, "doc_id", "left_anti").count() == 0
    assert got.join(docs.filter(F.lower("text").contains("licen")), "doc_id", "left_anti").count() == 0


def test_clashing_columns_and_empty_table(spark):
    df = cases.clashing(spark).withColumn("path", F.lit("a/b")).withColumn("licence", F.lit("x")).withColumn("origin", F.lit("x"))
    assert c.licensed(df).count() == len(cases.ROWS)
    assert c.licensed(cases.none(spark).withColumn("path", F.lit("a"))).collect() == []


def test_common_words_around_a_notice_weigh_little_at_any_size(spark):
    notice = "This project is released under the MIT License"
    found = []
    for size in (200, 20_000):
        plain = spark.range(1, size).select(F.col("id").alias("doc_id"), F.lit("This project is large").alias("text"), F.lit("z/y").alias("path"))
        # The licence terms keep their share of the documents.
        other = F.when(F.col("doc_id") % 10 == 0, "released").when(F.col("doc_id") % 10 == 1, "under the license").otherwise(F.col("text"))
        docs = plain.withColumn("text", F.when(F.col("doc_id") == 5, notice).otherwise(other))
        row = c.licensed(docs).filter("doc_id = 5").first()
        assert row["licence"] == "MIT"
        found.append(row["similarity"])
    assert found[1] > found[0] - 0.01
