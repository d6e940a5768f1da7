import re
import time

from pyspark.sql import functions as F

from cubegraph.llm import quality as q
from tests.llm import cases


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


TEXTS = ["a b c a b c", "a a a a", "x y z\nx y z\n\nq", "a b c d a b c", "# * | <b>", "one two", "a\x0bb\x0cc\x1cd", "r s t " * 40, "A B C D " * 20]


def test_measures(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + k, r[1]) for k, r in enumerate(cases.ROWS)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in q.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = []
    for rules in (q.RULES, q.RULES[::-1]):
        kept.append({r["doc_id"] for r in q.cascaded(docs, rules).filter(F.col("rejected_by").isNull()).collect()})
    assert kept[0] == kept[1] == {r["doc_id"] for r in q.judged(docs).filter("kept").collect()}


def test_rules_run_by_rejections_per_second():
    r = q.RULES
    found = [q.Estimate(r[0], 1.0, 0.1), q.Estimate(r[1], 0.1, 0.1), q.Estimate(r[2], 0.5, 0.0)]
    assert [x.name for x in q.ordered(found)] == [r[1].name, r[0].name, r[2].name]


def test_a_filter_costs_no_more_than_the_measures(spark):
    """Also where Spark pushes the filter down to the texts: twice the words, about twice the time."""

    def seconds(words):
        docs = spark.createDataFrame([(i, cases.prose(words, i)) for i in range(8)], "doc_id long, text string")
        judged = q.judged(docs).filter("kept OR base_failed")
        judged.count()
        start = time.perf_counter()
        assert judged.count() == 8
        return time.perf_counter() - start

    assert seconds(8000) < 6 * seconds(2000) + 1


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = q.judged(docs).join(labels, "doc_id")
    assert both.filter("quality = 1 AND NOT kept AND NOT base_failed").count() == 0
    assert both.filter("quality = 0 AND kept").count() <= 0.02 * both.filter("quality = 0").count()


def test_clashing_columns_and_empty_table(spark):
    assert q.judged(cases.clashing(spark)).count() == len(cases.ROWS)
    assert q.judged(cases.none(spark)).collect() == []
    assert q.cascaded(cases.documents(spark)).count() == len(cases.ROWS)
