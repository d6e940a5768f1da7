import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cubegraph.llm import runs as m
from tests.llm import cases


def brute(words):
    """All maximal stretches with their least period, by extending every match of every period."""
    n, found = len(words), {}
    for q in range(1, n // m.REPEATS + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(m.SHORTEST, m.REPEATS * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(left))


def periodic_text(r, n):
    words = [r.choice("ab") if r.random() < 0.5 else r.choice("abcdefgh") for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        a, p = r.randrange(n), r.randint(1, 12)
        end = min(n, a + p * r.randint(2, 9))
        for i in range(a + p, end):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_found(seed):
    r = random.Random(seed)
    texts = [periodic_text(r, r.choice([1, 23, 24, 25, 60, 200, 400])) for _ in range(120)]
    texts += [["a"] * 700, ["a", "b"] * 200, list("abcabcab") * 30, []]
    for words, found in zip(texts, m.runs_of_texts(texts)):
        assert list(map(tuple, found.runs.tolist())) == brute(words)


def test_extensions_are_the_longest():
    r = np.random.default_rng(3)
    for high in (2, 3, 50):
        words = r.integers(0, high, 600)
        words[200:420] = words[100:320]
        ext = m.CommonExtensions(words)
        i = r.integers(0, 600, 3000)
        j = r.integers(0, 600, 3000)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        expect = []
        for a, b in zip(i, j):
            k = 0
            while b + k < 600 and words[a + k] == words[b + k]:
                k += 1
            expect.append(k)
        assert ext.right(i, j).tolist() == expect


def test_many_different_words_do_not_overflow():
    words = np.arange(1 << 22, dtype=np.int64)
    words[3000:6000] = words[:3000]
    assert m.CommonExtensions(words).right(np.array([0, 5]), np.array([3000, 3005])).tolist() == [6000 - 3000, 2995]


def rows_of(spark, docs):
    return sorted((tuple(r) for r in m.searched(docs, m.DIGEST, m.digest, m.planted).collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows_of(spark, docs) == sorted((brute_row(*r) for r in docs.collect()), key=repr)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a " * 100, "x y " * 40 + "z", "é\x1cq " * 30, "1 2 3 " * 20 + "4 5 " * 20]
    rows = [(None, "a b " * 50), (None, None), *((i, t) for i, t in enumerate(texts * 8)), (3, "a " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spark, docs) == sorted((brute_row(*r) for r in rows), key=repr)


def test_collapsed_texts_and_runs(spark):
    docs = spark.createDataFrame([(1, "q " + "x y z " * 10 + "end")], "doc_id long, text string")
    (row,) = m.collapsed(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 3)] and row["collapsed"] == "q x y z end"


def test_clashing_columns_and_empty_table(spark):
    assert m.collapsed(cases.clashing(spark)).count() == len(cases.ROWS)
    assert m.collapsed(cases.none(spark)).collect() == []
