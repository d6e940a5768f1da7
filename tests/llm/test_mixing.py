import pytest
from pyspark.sql import functions as F

from cubegraph.llm import mixing as m
from tests.llm import cases


def test_margins_meet_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.described(docs)
    cells = rows.groupBy(*m.MARGINS).agg(F.sum("n_tokens").alias("mass"))
    targets = {k: m.tempered_targets(cells, k) for k in m.MARGINS}
    fitted = m.raked(cells, targets)
    for k, target in targets.items():
        got = fitted.groupBy(k).agg(F.sum("fitted").alias("f")).join(target, k).collect()
        assert sum(r["f"] for r in got) == pytest.approx(1, abs=1e-6)
        assert max(abs(r["f"] - r["share"]) for r in got) < 2e-3


def test_sampled_shares_follow_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = m.mixed(docs, rounds=6).filter("sampled").groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()
    cells = m.described(docs).groupBy(*m.MARGINS).agg(F.sum("n_tokens").alias("mass"))
    target = {r["lang"]: r["share"] for r in m.tempered_targets(cells, "lang").collect()}
    total = sum(r["n"] for r in rows)
    assert all(abs(r["n"] / total - target[r["lang"]]) < 0.06 for r in rows)


def test_probabilities_need_no_clipping(spark):
    got = m.mixed(cases.clashing(spark), rounds=2).collect()
    assert len(got) == len(cases.ROWS)
    assert max(r["probability"] for r in got) == 1 and min(r["probability"] for r in got) > 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}


def test_own_targets_leave_other_cells_out(spark):
    docs = cases.documents(spark)
    targets = {
        "source": spark.createDataFrame([("s0", 0.5), ("s2", 0.5)], "source string, share double"),
        "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "lang string, share double"),
    }
    got = m.mixed(docs, targets, rounds=2).collect()
    assert all((r["probability"] > 0) == (r["source"] in ("s0", "s2") and r["lang"] in ("en", "fr")) for r in got)


def test_rows_that_stay(spark):
    df = cases.clashing(spark)
    got = m.sampled(df, rounds=2)
    assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    assert ids == sorted((r["doc_id"] for r in m.mixed(df, rounds=2).filter("sampled").collect()), key=repr)
    assert m.mixed(cases.none(spark), rounds=1).collect() == [] and m.sampled(cases.none(spark), rounds=1).collect() == []


def test_one_odd_document_hardly_changes_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, "three odd words", "xx", "odd"), (-2, "", None, "odder")], docs.schema)
    kept = []
    for df in (docs, docs.unionByName(odd)):
        rows = m.mixed(df, rounds=4)
        expected, total = rows.agg(F.sum(F.col("probability") * F.col("n_tokens")), F.sum("n_tokens")).first()
        assert expected / total == pytest.approx(0.5, abs=1e-6)
        kept.append({r["doc_id"] for r in rows.filter("sampled").collect()})
    assert len(kept[0] ^ kept[1]) < 0.02 * len(kept[0])
