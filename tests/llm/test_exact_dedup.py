import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cubegraph.llm import exact_dedup as x
from tests.llm import cases


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out, done = Counter(), set()
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        kept = doc_id == keep and (text or "") not in done
        if kept:
            done.add(text or "")
        out[(doc_id, keep, len(ids), kept, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    return out


def test_groups(spark):
    got = Counter(tuple(r) for r in x.exact_duplicates(cases.documents(spark), size=100).collect())
    assert got == expected(cases.ROWS)


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, f"text {i % 9}", None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    got = Counter(tuple(r) for r in x.exact_duplicates(df, size=3, moduli=(3, 2)).collect())
    assert got == expected(rows)


def test_chunks_combine_to_the_whole():
    text = cases.prose(500, 3).encode()
    whole = x.chunk_hashes(pa.array([text], pa.binary()), np.array([0]), 1 << 20, x.MODULI)
    for size in (1, 7, 64):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        each = x.chunk_hashes(pa.array(parts, pa.binary()), np.arange(len(parts)), size, x.MODULI)
        assert [int(h.sum()) % m for h, m in zip(each, x.MODULI)] == [int(h[0]) for h in whole]


@pytest.mark.parametrize("frame", [cases.documents, cases.clashing])
def test_rows_that_stay(spark, frame):
    df = frame(spark)
    got = x.without_duplicates(df)
    assert got.columns == df.columns
    stay = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    kept = {k[0:1] + (k[4],) for k in expected(cases.ROWS) if k[3]}
    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in stay} == kept and len(stay) == len(kept)


def test_empty_table(spark):
    assert x.exact_duplicates(cases.none(spark)).collect() == []
    assert x.without_duplicates(cases.none(spark)).collect() == []
